"""E-mail addresses, record identifiers and websites."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .results import first_of, let, outcome, strip, warned

# Address lists and words that are no addresses.
FREEMAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com",
    "proton.me", "protonmail.com", "pm.me", "gmx.com", "mail.com", "zoho.com", "yandex.com", "inbox.com", "rocketmail.com", "ymail.com",
)
DISPOSABLE = (
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "throwawaymail.com", "trashmail.com", "yopmail.com", "sharklasers.com",
    "getnada.com", "dispostable.com", "maildrop.cc", "fakeinbox.com",
)
ROLES = (
    "info", "admin", "sales", "support", "hello", "contact", "team", "office", "enquiries", "inquiries", "marketing", "billing", "accounts", "hr", "jobs",
    "careers", "noreply", "no-reply", "webmaster", "postmaster", "help", "lead", "leads", "newsletter",
)
EMAIL_JUNK = ("email", "asdf", "test", "n/a", "na", "none", "-", "null", "test@test.com", "asdf@asdf.com")
ID_JUNK = ("asdf", "test", "testrow", "header", "lead_id", "id", "n/a", "na", "none", "null", "-")
WEB_JUNK = ("asdf", "test", "website", "n/a", "na", "none", "null", "-", "tbd", "no website", "none yet")
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.za", "com.au", "net.au", "org.au", "co.nz", "com.ng", "org.ng", "co.ke", "com.br", "co.in", "com.sg", "co.jp",
    "com.mx", "com.tr", "co.il", "com.gh",
)
REPAIRS = (
    (r"(?i)\s*\[\s*at\s*\]\s*", "@"),
    (r"(?i)\s*\(\s*at\s*\)\s*", "@"),
    (r"(?i)\s+at\s+(?=[A-Za-z0-9-]+\.[A-Za-z]{2,})", "@"),
    (r"(?i)\s*\{\s*at\s*\}\s*", "@"),
    (r"(?i)\s*\[\s*dot\s*\]\s*", "."),
    (r"(?i)\s*\(\s*dot\s*\)\s*", "."),
)
LOCAL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$"
LABEL = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
TLD = r"^[A-Za-z]{2,24}$"
ID_PATTERN = r"^(?P<prefix>[A-Za-z]{1,5})?[\s_-]*(?P<number>\d+)(?:[\s_-]+(?P<suffix>[A-Za-z0-9_-]+))?$"


@dataclass(frozen=True)
class EmailConfig:
    repair_obfuscation: bool = True
    lowercase: bool = True
    strip_display_name: bool = True
    flag_freemail: bool = True
    flag_role: bool = True
    reject_freemail: bool = False
    extra_freemail: tuple[str, ...] = ()
    extra_disposable: tuple[str, ...] = ()


def parse_email(text: Column, config: EmailConfig | None = None) -> Column:
    """struct result whose value has address, local, domain, tld, is_freemail, is_role and is_disposable."""
    c = config or EmailConfig()
    raw = F.coalesce(text.cast("string"), F.lit(""))

    def named(s: Column) -> Column:
        inner = F.regexp_extract(s, "<([^>]+)>", 1)
        shown = F.when(F.lit(c.strip_display_name) & (inner != ""), strip(inner)).otherwise(s)
        return let(shown, lambda x: repaired(s, x))

    def repaired(s: Column, shown: Column) -> Column:
        fixed = shown
        if c.repair_obfuscation:
            for pattern, sign in REPAIRS:
                fixed = F.regexp_replace(fixed, pattern, sign)
        return let(fixed, lambda x: let(F.regexp_replace(F.btrim(strip(x), F.lit(".,;:")), "(?i)^mailto:", ""), lambda y: closed(s, shown, x, y)))

    def closed(s: Column, shown: Column, fixed: Column, x: Column) -> Column:
        ats = F.length(x) - F.length(F.replace(x, F.lit("@"), F.lit("")))
        return let(
            F.struct(strip(F.substring_index(x, "@", 1)).alias("local"), strip(F.substring_index(x, "@", -1)).alias("domain"), ats.alias("ats")),
            lambda p: ended(s, shown, fixed, p["local"], p["domain"], p["ats"]),
        )

    def ended(s: Column, shown: Column, fixed: Column, local: Column, domain: Column, ats: Column) -> Column:
        low = F.lower(domain) if c.lowercase else domain
        own = F.lower(local) if c.lowercase else local
        labels = F.split(domain, r"\.", -1)
        tld = F.element_at(labels, -1)
        free = low.isin(*FREEMAIL, *c.extra_freemail)
        role = F.split(own, r"\+").getItem(0).isin(*ROLES)
        gone = low.isin(*DISPOSABLE, *c.extra_disposable)
        failure = first_of(
            (s == "", "EMPTY"),
            (F.lower(s).isin(*EMAIL_JUNK), "JUNK"),
            (ats == 0, "EMAIL_NO_AT"),
            (ats > 1, "EMAIL_MULTIPLE_AT"),
            (local == "", "EMAIL_MISSING_LOCAL"),
            (domain == "", "EMAIL_MISSING_DOMAIN"),
            (~local.rlike(LOCAL) | local.startswith(".") | local.endswith(".") | local.contains(".."), "EMAIL_INVALID_CHARS"),
            (domain.contains(" "), "EMAIL_INVALID_CHARS"),
            (~domain.contains("."), "EMAIL_MISSING_TLD"),
            (F.exists(labels, lambda x: ~x.rlike(LABEL)), "EMAIL_INVALID_CHARS"),
            (~tld.rlike(TLD), "EMAIL_INVALID_TLD"),
            (free & F.lit(c.reject_freemail), "EMAIL_FREEMAIL"),
        )
        code = F.when(fixed != shown, "OK_REPAIRED").when((shown != s) | s.rlike("<[^>]+>") & F.lit(c.strip_display_name) | (low != domain), "OK_NORMALISED").otherwise("OK")
        value = F.struct(
            F.concat(own, F.lit("@"), low).alias("address"),
            own.alias("local"),
            low.alias("domain"),
            F.lower(tld).alias("tld"),
            free.alias("is_freemail"),
            role.alias("is_role"),
            gone.alias("is_disposable"),
        )
        warnings = warned((free & F.lit(c.flag_freemail), "EMAIL_FREEMAIL"), (gone, "EMAIL_DISPOSABLE"), (role & F.lit(c.flag_role), "EMAIL_ROLE_ADDRESS"))
        return outcome(raw, failure, code, value, warnings)

    return let(strip(raw), named)


@dataclass(frozen=True)
class LeadIdConfig:
    pattern: str = ID_PATTERN
    canonical_format: str = "{prefix}-{number}"
    default_prefix: str = "L"
    pad_to: int = 0
    uppercase_prefix: bool = True
    allow_missing_prefix: bool = True
    junk: tuple[str, ...] = ID_JUNK
    invalid_sort_last: bool = True


def group_numbers(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern in Spark's dialect, and the number of each named group."""
    return re.sub(r"\(\?P<", "(?<", pattern), dict(re.compile(pattern).groupindex)


def parse_lead_id(text: Column, config: LeadIdConfig | None = None) -> Column:
    """struct result whose value has canonical, prefix, number (decimal), suffix and had_prefix."""
    c = config or LeadIdConfig()
    pattern, groups = group_numbers(c.pattern)
    raw = F.coalesce(text.cast("string"), F.lit(""))
    part = lambda s, name: F.regexp_extract(s, pattern, groups[name]) if name in groups else F.lit("")

    def read(s: Column) -> Column:
        prefix = F.btrim(part(s, "prefix"), F.lit("-_ "))
        found = F.struct(prefix.alias("prefix"), part(s, "number").try_cast("decimal(38,0)").alias("number"), strip(part(s, "suffix")).alias("suffix"))
        return let(found, lambda p: closed(s, p))

    def closed(s: Column, p: Column) -> Column:
        had = p["prefix"] != ""
        shown = F.when(had, p["prefix"]).otherwise(c.default_prefix)
        shown = F.upper(shown) if c.uppercase_prefix else shown
        number = p["number"].cast("string")
        if c.pad_to:
            number = F.lpad(number, F.greatest(F.length(number), F.lit(c.pad_to)), F.lit("0"))
        pieces = [shown if x == "{prefix}" else number if x == "{number}" else F.lit(x) for x in re.split(r"(\{prefix\}|\{number\})", c.canonical_format) if x]
        canonical = F.concat(*pieces, F.when(p["suffix"] != "", F.concat(F.lit("-"), p["suffix"])).otherwise(""))
        failure = first_of(
            (s == "", "ID_MISSING"),
            (F.lower(s).isin(*c.junk), "JUNK"),
            (~s.rlike(pattern) & ~s.rlike(r"\d"), "ID_NO_NUMBER"),
            (~s.rlike(pattern) | p["number"].isNull() | (~had & F.lit(not c.allow_missing_prefix)), "ID_MALFORMED"),
        )
        value = F.struct(canonical.alias("canonical"), shown.alias("prefix"), p["number"].alias("number"), p["suffix"].alias("suffix"), had.alias("had_prefix"))
        code = F.when(had & (p["suffix"] == ""), "OK").otherwise("OK_NORMALISED")
        return outcome(raw, failure, code, value, warned((p["suffix"] != "", "ID_HAS_SUFFIX")))

    return let(strip(raw), read)


@dataclass(frozen=True)
class WebsiteConfig:
    default_scheme: str = "https"
    strip_www: bool = True
    lowercase_host: bool = True
    keep_path: bool = False
    keep_query: bool = False
    allow_ip: bool = False
    require_tld: bool = True
    extra_junk: tuple[str, ...] = ()


def registrable(host: Column) -> Column:
    """struct<domain, tld>: the last two labels of a host, or three where the last two are one public suffix."""
    labels = F.split(host, r"\.", -1)
    n, last2 = F.size(labels), F.array_join(F.slice(labels, -2, 2), ".")
    two = (n >= 3) & last2.isin(*TWO_PART_SUFFIXES)
    return (
        F.when(two, F.struct(F.array_join(F.slice(labels, F.lit(-3), F.lit(3)), ".").alias("domain"), last2.alias("tld")))
        .when(n >= 2, F.struct(last2.alias("domain"), F.element_at(labels, -1).alias("tld")))
        .otherwise(F.struct(host.alias("domain"), F.lit("").alias("tld")))
    )


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def parse_website(text: Column, config: WebsiteConfig | None = None) -> Column:
    """struct result whose value has url, scheme, host, registrable_domain, tld, path, had_scheme and had_www."""
    c = config or WebsiteConfig()
    raw = F.coalesce(text.cast("string"), F.lit(""))

    def read(s: Column) -> Column:
        http = s.rlike("(?i)^https?://")
        shown = F.when(s.rlike(r"\s") & ~http, F.split(s, r"\s+").getItem(0)).otherwise(s)
        return let(F.struct(shown.alias("s"), shown.rlike(_SCHEME).alias("had"), (shown.contains("@") & ~http).alias("mail")), lambda p: split(s, p))

    def split(s: Column, p: Column) -> Column:
        url = F.when(p["had"], p["s"]).otherwise(F.concat(F.lit(f"{c.default_scheme}://"), p["s"]))
        rest = F.regexp_replace(url, _SCHEME, "")
        net = F.regexp_extract(rest, r"^[^/?#]*", 0)
        host = F.btrim(F.regexp_replace(F.regexp_replace(net, "^.*@", ""), r":[0-9]*$", ""), F.lit("."))
        tail = F.substring(rest, F.length(net) + 1, F.length(rest))
        parts = F.struct(
            F.lower(F.substring_index(url, "://", 1)).alias("scheme"),
            F.lower(host).alias("host"),
            F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"),
            F.regexp_extract(tail, r"\?([^#]*)", 1).alias("query"),
        )
        return let(parts, lambda u: closed(s, p, u))

    def closed(s: Column, p: Column, u: Column) -> Column:
        host = u["host"]
        labels = F.split(host, r"\.", -1)
        ip = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
        www = host.startswith("www.")
        final = F.when(www & F.lit(c.strip_www), F.substring(host, F.lit(5), F.length(host))).otherwise(host)
        path = F.when((u["path"] == "/") | F.lit(not c.keep_path), "").otherwise(u["path"])
        query = F.when(F.lit(c.keep_query) & (u["query"] != ""), F.concat(F.lit("?"), u["query"])).otherwise("")
        failure = first_of(
            (s == "", "EMPTY"),
            (F.lower(s).isin(*WEB_JUNK, *c.extra_junk), "JUNK"),
            (p["mail"], "WEB_IS_EMAIL"),
            ((host == "") | (ip & F.lit(not c.allow_ip)), "WEB_INVALID_HOST"),
            (~ip & ~host.contains("."), "WEB_NO_DOT"),
            (~ip & F.exists(labels, lambda x: ~x.rlike(LABEL)), "WEB_INVALID_HOST"),
            (~ip & F.lit(c.require_tld) & ~F.element_at(labels, -1).rlike(TLD), "WEB_INVALID_TLD"),
        )

        def value(r: Column) -> Column:
            return F.struct(
                F.concat(u["scheme"], F.lit("://"), final, path, query).alias("url"),
                u["scheme"].alias("scheme"),
                final.alias("host"),
                r["domain"].alias("registrable_domain"),
                r["tld"].alias("tld"),
                path.alias("path"),
                p["had"].alias("had_scheme"),
                www.alias("had_www"),
            )

        code = F.when(~p["had"] | (www & F.lit(c.strip_www)), "OK_NORMALISED").otherwise("OK")
        return outcome(raw, failure, code, let(registrable(final), value), warned((~p["had"], "WEB_SCHEME_ADDED")))

    return let(F.btrim(strip(raw), F.lit("<>\"'")), read)


def domains_match(website: Column, email_domain: Column) -> Column:
    """Whether a website result and a mail domain share the registrable domain; null where either is missing."""
    return F.when(F.length(email_domain) > 0, registrable(F.lower(email_domain))["domain"] == website["value"]["registrable_domain"])
