"""Settings from files: which columns, words and limits a run uses."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.amounts import AmountConfig
from ..functions.contacts import EmailConfig, LeadIdConfig, WebsiteConfig
from ..functions.dates import DateConfig
from ..functions.fit import PROFILE_COMPANY, PROFILE_NOT, PROFILE_NOTES, SIZE_BANDS, SOURCE_QUALITY, TITLES, NON_BUYERS

# Canonical fields with the header names that are taken for them, marks of test rows, and the usual file.
FIELDS = {
    "lead_id": ("lead_id", "id", "lead id", "leadid", "ref"),
    "created": ("created", "created_at", "date", "submitted", "timestamp"),
    "name": ("name", "contact", "full_name", "contact_name"),
    "email": ("email", "email_address", "e-mail"),
    "company": ("company", "organisation", "organization", "account"),
    "employees": ("employees", "headcount", "company_size", "size", "staff"),
    "website": ("website", "site", "url", "domain", "web"),
    "title": ("title", "job_title", "role", "position"),
    "source": ("source", "channel", "lead_source", "utm_source"),
    "monthly_budget": ("monthly_budget", "budget", "spend", "monthly budget"),
    "notes": ("notes", "note", "message", "comments", "enquiry", "description"),
}
DROP = {"lead_id": ("header", "testrow", "asdf", "test"), "source": ("test", "source")}
DEFAULT_PATH = "data/default_leads.csv"


def read_settings(path: str) -> dict:
    """A JSON, TOML or YAML file as a dict; an empty one gives {}."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text or "{}")
    if path.endswith(".toml"):
        return tomllib.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML settings need PyYAML; JSON and TOML do not") from e
    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Settings:
    """Everything about reading and cleaning contacts that a file can set."""

    amount: AmountConfig = field(default_factory=AmountConfig)
    date: DateConfig = field(default_factory=DateConfig)
    email: EmailConfig = field(default_factory=EmailConfig)
    lead_id: LeadIdConfig = field(default_factory=LeadIdConfig)
    website: WebsiteConfig = field(default_factory=WebsiteConfig)
    infer_order: bool = True
    fields: dict = field(default_factory=lambda: dict(FIELDS))
    drop: dict = field(default_factory=lambda: dict(DROP))
    size_bands: tuple = SIZE_BANDS
    titles: dict = field(default_factory=lambda: dict(TITLES))
    non_buyers: tuple = NON_BUYERS
    quality: dict = field(default_factory=lambda: dict(SOURCE_QUALITY))
    profile: dict = field(default_factory=lambda: {"company": PROFILE_COMPANY, "notes": PROFILE_NOTES, "not": PROFILE_NOT})
    default_path: str = DEFAULT_PATH
    encoding: str = "utf-8"


def _known(section: dict, kind, rename: dict | None = None) -> dict:
    """The keys of a section that the configuration has, lists as tuples."""
    named = {(rename or {}).get(k, k): v for k, v in section.items()}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in named.items() if k in kind.__dataclass_fields__}


def load_settings(path: str | None = None, data: dict | None = None) -> Settings:
    """Settings of a file or dict with the sections dataset, mapping, parsing, employees, titles, sources and icp; what is missing keeps its default."""
    raw = read_settings(path) if data is None and path else data or {}
    dataset, parsing = raw.get("dataset") or {}, raw.get("parsing") or {}
    part = lambda name: dict(parsing.get(name) or {})
    levels = {k.upper(): tuple(v) for k, v in ((raw.get("titles") or {}).get("authority") or {}).items()}
    bands = tuple((b["name"], b.get("min", 0), b.get("max", 999_999)) for b in (raw.get("employees") or {}).get("bands") or ())
    icp = raw.get("icp") or {}
    profile = {k: tuple(icp.get(name) or ()) for k, name in (("company", "positive_company_patterns"), ("notes", "agency_note_patterns"), ("not", "disqualifying_note_patterns"))}
    drop = dataset.get("drop_rows_matching")
    base = Settings()
    return Settings(
        amount=AmountConfig(**_known(part("amount"), AmountConfig)),
        date=DateConfig(**_known(part("date"), DateConfig)),
        email=EmailConfig(**_known(part("email"), EmailConfig)),
        lead_id=LeadIdConfig(**_known(part("lead_id"), LeadIdConfig)),
        website=WebsiteConfig(**_known(part("website"), WebsiteConfig)),
        infer_order=bool(part("date").get("infer_order_from_column", True)),
        fields={k: tuple(v) for k, v in (raw.get("mapping") or base.fields).items()},
        drop=base.drop if drop is None else {k: tuple(str(w).lower() for w in v) for k, v in drop.items()},
        size_bands=bands or base.size_bands,
        titles=levels or base.titles,
        non_buyers=tuple((raw.get("titles") or {}).get("non_buyer") or base.non_buyers),
        quality=dict((raw.get("sources") or {}).get("quality") or base.quality),
        profile=profile if icp else base.profile,
        default_path=dataset.get("default_path", base.default_path),
        encoding=dataset.get("encoding", base.encoding),
    )


def default_dataset_path(settings: Settings | None = None, root: str | None = None) -> str:
    """Place of the usual contact file: as set if absolute or a URI, otherwise below ``root`` (the folder above this package)."""
    path = (settings or Settings()).default_path
    if Path(path).is_absolute() or "://" in path:
        return path
    return str(Path(root or Path(__file__).resolve().parents[2]) / path)
