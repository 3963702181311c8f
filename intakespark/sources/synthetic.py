"""A contact table made from the customer table by SQL that Spark and other engines read alike."""

from .shared import tasks_for

_IDS = ["'L-' || cast(k as varchar)", "'L-' || cast(k as varchar)", "cast(k as varchar)", "'acme_' || cast(k as varchar)", "'L-' || cast(k - 3 as varchar) || '-dup'", "'L-000' || cast(k as varchar)", "''", "'header'", "'no-digits-here'", "'L--' || cast(k as varchar) || '!'", "'asdf'", "'  l ' || cast(k as varchar)", "cast(k as varchar) || ' B2'", "'TEST'", "'n/a'"]
_DATES = [
    "lpad(cast(k % 12 + 1 as varchar), 2, '0') || '/' || lpad(cast(k % 28 + 1 as varchar), 2, '0') || '/2024'", "lpad(cast(k % 28 + 1 as varchar), 2, '0') || '-' || lpad(cast(k % 12 + 1 as varchar), 2, '0') || '-2024'",
    "'2024-' || cast(k % 12 + 1 as varchar) || '-' || cast(k % 28 + 1 as varchar)", "'Jun ' || cast(k % 30 + 1 as varchar) || ' 2024'", "cast(k % 31 + 1 as varchar) || 'th June 24'", "'2024' || lpad(cast(k % 12 + 1 as varchar), 2, '0') || '07'",
    "'2024-06-08T09:30:00'", "'Jun 2023'", "'2023-11'", "'31/31/2024'", "'02/30/2024'", "'soon'", "''", "'tbd'", "'12/01/1975'", "'03.04.24'", "'June ' || cast(k % 30 + 1 as varchar) || ', 2024'", "'7 Jun 69'", "'19.06.2024'", "'2024/6/' || cast(k % 28 + 1 as varchar)", "'12/31/99'", "'45-46-2024'", "'2024-13-45'", "'Sept 2022'", "'1/2/2031'", "' 06/28/2024, '", "'3rd of May'"]
_EMAILS = ["'user' || cast(k as varchar) || '@firm' || cast(k % 40 as varchar) || '.com'", "'kunle[at]meridian' || cast(k % 7 as varchar) || '.com'", "'blessing@proton.me'", "'info@acme.com'", "'Jane Doe <jane@Acme.com>'", "'ivan@'", "'@acme.com'", "'obi@leverageside'", "'a@b@c.com'", "''", "'n/a'", "'plain'", "'x y@acme.com'", "'z@acme.c0m'", "'tmp@yopmail.com'", "'a..b@acme.com'", "'Ada@ACME.io'", "'ola at firm.co.uk'", "'ben(at)corp(dot)com'", "'mailto:kay@corp.com'", "'sales+x@corp.com'", "'x' || cast(k as varchar) || '@gmail.com'", "'test@test.com'", "'.a@b.com'", "'a@b..com'", "'a@-b.com'", "'hr{at}firm.io'"]
_SITES = ["'firm' || cast(k % 40 as varchar) || '.com'", "'www.apexsend.co'", "'http://upshiftloop.agency/path?q=1'", "'https://x.co.uk/path'", "'sub.foo.com.ng'", "'localhost'", "'foo.123'", "''", "'n/a'", "'me@acme.com'", "'a_b.com'", "'10.0.0.1'", "'firm.com and more'", "'https://www.Foo.com/'", "'https://user@host.com/x'", "'foo.com:8080'", "'ftp://files.acme.org'", "'tbd'", "' acme.io '"]
_SIZES = ["'35-55'", "'19+'", "'4+'", "'1'", "'30'", "''", "'many'", "cast(k % 120 as varchar)", "'10-15'", "'1,200'", "'2-3'", "'4 to 5 people'"]
_TITLES = ["'Founder'", "'Head of Ops'", "'Student'", "'Marketing Manager'", "'Director of Sales'", "''", "'Accountant'", "'Recruiter'", "'CEO'", "'VP '", "'Managing Partner'", "'Intern'", "' Co-Founder '", "'Software Engineer'"]
_SOURCES = ["'referral'", "'linkedin'", "'event'", "'cold reply'", "'Webform'", "'radio'", "''", "'test'"]
_BUDGETS = ["'6k'", "'$12k'", "'$6k-$8k'", "'$6-8k'", "'between 5 and 8k'", "'0'", "'TBD'", "'$5/hr'", "'$120,000/yr'", "''", "'asdf'", "'up to 10k'", "'10k+'", "'around 7k per month'", "'900 per week'", "'lots'", "'99999999'", "'8k-6k'", "'£2.5m total'", "cast(k * 3 as varchar)", "'₦2.5m'", "'€4k/mo'", "'₹90000 per quarter'", "'5,000 NGN weekly'", "'300 USD a day'", "'zar 12k'", "'kes 40k monthly'", "'under £3k per month'", "'circa 12k p.a.'", "'won''t share'", "'over 20k one-off'", "'$8,500/mth'", "'10000 to 12000'", "'us$7k'", "'3k/q'", "'EUR 5000'", "'not decided'", "'5,00,0'", "'1.5m - 2m'", "'500 - 2k'"]
_COMPANIES = ["'Bright Agency'", "'Acme'", "'Northern Media'", "'Corner Shop'", "'Growth Lab'", "'Lead Gen Partners'", "''", "'Seo & Ppc Ltd'"]
# Notes whose readings are known.
_KNOWN = (
    "We are a full-service marketing agency, 23 people. Summarizing call recordings into crm notes is eating our week. Want it automated end to end. Budget approved, ready to pilot in the next 2 weeks. I make the call here.",
    "This is a priority, but we do not have a budget until next quarter.",
    "very early startup, 3 people, no real budget yet but sharp.",
    "Car dealership wanting a lead chatbot. Not your usual client but we have money to spend.",
    "Not looking to buy, I am a developer looking for a role. Attaching my CV.",
    "hi! CS student, i love what you do. could you send a free template?",
    "You have WON $1,000,000!!! Click here to claim.",
    "VC here, wanting to intro you to a few portfolio companies.",
    "Journalist writing about the AI automation space, looking for a quote.",
    "Exploring automating qualifying inbound leads. Comparing a few options.",
    "Interested in automating lead routing.",
    "",
    "I actually run a competing automation agency, just seeing how you package your offer.",
)
#: Further notes, so that every rule, type, reason, horizon and problem of the default lexicon is met.
_MORE = (
    "We shortlisted two vendors and the decision is mine. Keen to move fast.",
    "Evaluating tools now, can we get a demo? Would need to loop in the team.",
    "Curious about automating our shared inbox, early days, not totally sure what we need.",
    "We budgeted for this and there is budget left. Start within 3 weeks.",
    "Budget is not locked, depends what you can do. Reviewing proposals next month.",
    "Tight budget, looking for the cheapest option. One-man shop.",
    "We can't pay anything, free only please.",
    "Need help asap, we are drowning in call notes and losing clients.",
    "It could go live in 6 months, or by Q3, with a real budget.",
    "Maybe later, eventually. No rush.",
    "No immediate plans, on hold for now. Circle back next spring.",
    "We copy-paste data between HubSpot and google sheets by hand, which is tedious.",
    "Would be nice to have dashboards, not a big deal.",
    "Our biggest problem is the shared inbox; we struggle with inbox triage and leads go stale.",
    "Everything is fine, no particular problem, not looking for help.",
    "I'll take it to our CEO. Recommending this internally, since it is a top priority.",
    "Not sure who signs off, it is not my decision.",
    "We are not comparing options, you're our first choice and my call.",
    "We don't have money to spend, but we want to automate client reports.",
    "We never budgeted for this, however funding is approved and we want it automated end to end this week.",
    "Buy followers from our SMM panel, crypto accepted. Reply stop to opt out.",
    "Newsletter signup, ended up in the leads sheet by mistake.",
    "We sell offshore dev teams at $25/hr, want to partner?",
    "We have devs on our bench, could place candidates with you.",
    "Market research: can I interview you about agencies? I am not a client.",
    "White-label for agencies or a reseller deal? Referral partnership, collaborate rather than buy.",
    "Fellow agency owner, we do similar work, pricing for benchmarking.",
    "I'm a bootcamp grad doing a project on lead scoring for my thesis, just learning.",
    "We\u2019re an outbound agency \u2014 12 people \u2014 and can\u2019t keep up with follow-ups\u2026 want to automate lead enrichment asap.",
    "Is it possible to transcribe meetings? Considering it for next year, perhaps.",
    "No doubt we need this: approved the budget, send the contract. When can we start?",
    "We might want to embed an AI assistant on our site, drafting cold messages, pacing ad budgets across 14 clients.",
    "Small local business, freelance marketer. Limited budget but willing to invest.",
    "Revisit in June. No budget until then, because leads are slow.",
    "This month is hectic; a couple of weeks after that, though, we decide. Our founder will decide.",
    "Want to add an AI service line and resell automation. No longer on hold. Getting quotes and talking to several agencies.",
    "Moving leads between Apollo and Salesforce manually across 30 accounts, one by one. Hours every day.",
    "Hire our developers. Are you hiring?",
    "it would be fine. it would not. still, however, but no",
    "WhatsApp and email automation, internal AI tools, spreadsheets to CRM. By the end of the month.",
    "Looking for a quote on lead routing. Not right now.",
    "interested?",
    "   ",
)
NOTES = _KNOWN + _MORE


def _pick(key: str, options: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(options)} = {k} THEN {o}" for k, o in enumerate(options)) + " END"


def contacts_sql(table: str = "customer") -> str:
    """SELECT of seq and the canonical fields, from the keys of the customer table."""
    notes = ["'" + n.replace("'", "''") + "'" for n in NOTES]
    return f"""SELECT k AS seq, {_pick("k", _IDS)} AS lead_id, {_pick("k", _DATES)} AS created, 'Contact ' || cast(k as varchar) AS name, {_pick("k", _EMAILS)} AS email,
  {_pick("k", _COMPANIES)} AS company, {_pick("k", _SIZES)} AS employees, {_pick("k", _SITES)} AS website, {_pick("k", _TITLES)} AS title, {_pick("k", _SOURCES)} AS source,
  {_pick("k", _BUDGETS)} AS monthly_budget, {_pick("k", notes)} AS notes
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {table}) keys"""


def contacts(spark, sf_dir: str):
    """The contact table over a folder of the test tables. Its file is one task to read, so the keys alone are dealt out, to as many tasks as their number asks for, and rows are made of them there."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys.repartition(tasks_for(spark, keys.count())).createOrReplaceTempView("_synthetic_customer")
    return spark.sql(contacts_sql("_synthetic_customer").replace("as varchar", "as string"))
