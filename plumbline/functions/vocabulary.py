"""Fixed values of the clause checks: word lists, phrases, units and codes, in their given order."""

NEGATIONS = ("not", "no", "never", "cannot", "nor", "neither", "without", "none", "nothing")
QUOTE_NEGATIONS = ("not", "no", "never", "cannot", "nor", "neither", "without", "unless", "except")
PROHIBITIONS = (
    "prohibited", "forbidden", "barred", "precluded", "restricted from", "may not", "shall not", "must not", "will not", "cannot", "can not",
    "is not permitted", "are not permitted", "not entitled",
)
OBLIGATIONS = ("must", "shall", "is required", "are required", "is obliged", "are obliged", "has to", "have to", "is obligated", "are obligated", "undertakes to")
PERMISSIONS = (
    "may", "can", "is entitled", "are entitled", "is permitted", "are permitted", "at its option", "at their option", "is free to",
    "reserves the right", "reserve the right", "shall have the right", "has the right", "have the right", "is authorized", "is authorised",
    "at its discretion", "at their discretion", "may elect",
)
CERTAINTY = (
    "automatically", "automatic", "always", "guarantee", "guarantees", "guaranteed", "in all cases", "without exception", "invariably",
    "is certain", "will certainly", "in every case",
)
RESTRICTIVE = (
    "only", "some", "certain", "listed", "specified", "up to", "at least", "no more than", "not exceeding", "limited to", "partial",
    "a maximum of", "a minimum of", "solely", "sole", "exclusively", "not later than", "no later than", "at most", "within",
)
UNIVERSAL = ("all", "any", "every", "entire", "whole", "unlimited", "without limit", "in full", "everyone", "everything")
EXCEPTIONS = (
    "except", "excepted", "excepting", "except for", "except as", "excluding", "excluded", "other than", "save for", "save as", "apart from",
    "with the exception of", "notwithstanding",
)
BEFORE = ("before", "prior to", "preceding", "in advance of", "until")
AFTER = ("after", "following", "subsequent to", "once", "upon expiry")
INDEFINITE = ("immediately", "permanently", "perpetually", "indefinitely", "forever", "in perpetuity", "at any time", "without time limit", "for all time")
REFERENCES = (
    "has the meaning", "shall have the meaning", "as defined in", "as described in", "as set out in", "set out in", "specified in",
    "referred to in", "in accordance with schedule", "see schedule", "as listed in", "set forth in",
)
CONDITIONS = (
    "if", "unless", "provided that", "subject to", "in the event", "where", "when", "upon", "should", "on condition", "contingent", "except",
    "save that", "so long as", "as long as", "in case of", "in the case of",
)
INJECTIONS = (
    "ignore all previous", "ignore previous", "ignore the above", "ignore prior", "ignore your", "disregard all previous", "disregard previous",
    "disregard the above", "disregard your", "system prompt", "system message", "you are now", "pretend to be", "tell the user", "say to the user",
    "new instructions", "updated instructions", "developer mode", "override your", "reveal your", "print your", "output your", "api key",
    "release every", "mark as verified", "verification rules",
)
COMMANDS = (
    "ignore", "disregard", "forget", "reveal", "print", "output", "return", "say", "tell", "respond", "reply", "answer", "override", "bypass",
    "pretend", "act", "behave", "assume", "stop", "skip", "omit", "release", "mark", "classify", "treat", "follow", "execute", "run",
)
ROLES = (
    "party", "parties", "customer", "client", "supplier", "vendor", "contractor", "subcontractor", "employee", "employer", "landlord", "tenant",
    "licensor", "licensee", "buyer", "seller", "purchaser", "provider", "recipient", "discloser", "lessor", "lessee", "consultant", "agent",
    "borrower", "lender", "company", "government", "authority", "agency", "department", "officer", "processor", "controller", "bank", "insurer",
    "guarantor", "trustee", "principal", "distributor", "manufacturer", "owner", "operator", "assignee", "sponsor", "importer", "exporter",
    "executive", "subprocessor", "transferor", "transferee", "franchisor", "franchisee", "indemnitor", "indemnitee", "obligor", "obligee",
    "mortgagor", "mortgagee", "shipper", "carrier", "consignee",
)
#: Roles that count as another one.
ROLE_ALIASES = {"parties": "party", "client": "customer", "vendor": "supplier", "purchaser": "buyer"}
#: Nouns that name documents and their contents, no organisation.
DOCUMENT_NOUNS = (
    "agreement", "contract", "lease", "clause", "section", "article", "exhibit", "schedule", "annex", "appendix", "addendum", "amendment",
    "release", "notice", "term", "terms", "rent", "fee", "fees", "payment", "payments", "price", "invoice", "premises", "property", "goods",
    "service", "services", "software", "system", "platform", "information", "data", "work", "works", "policy", "plan", "report", "record",
    "records", "document", "documents", "provision", "provisions", "obligation", "obligations", "right", "rights", "claim", "claims", "damages",
    "insurance", "coverage", "interest", "penalty", "default", "breach", "date", "period", "time", "times", "order", "credit", "credits",
    "specification", "specifications", "warranty", "warranties", "confidentiality", "employment", "termination", "board", "committee", "law",
    "laws", "court", "failure", "continuance", "compliance", "transfer", "processing", "purpose", "purposes", "business", "subject", "subjects",
    "instructions", "media", "access", "support", "delay",
)
#: Verbs whose subject acts, as a pattern, and the most words of a name.
SUBJECT_VERBS = (
    "shall|must|may|will|agrees?|undertakes|reserves|warrants|represents|acknowledges|covenants|indemnifies|grants|consents|elects|"
    r"(?:is|are)\s+(?:entitled|responsible|required|obliged|obligated|liable|permitted|prohibited|authorized|authorised|free)"
)
NAME_WORDS = 4
REPORTING = (
    "wrote", "writes", "stated", "states", "said", "says", "confirmed", "confirms", "advised", "advises", "emailed", "informed", "informs",
    "told", "replied", "noted", "commented", "announced", "alleged", "claimed",
)
CONCLUSIONS = ("verified", "unenforceable", "enforceable", "legally binding", "guarantee", "guarantees", "guaranteed", "you should sign", "you should not sign")
SETTLED_WORDS = ("agreement", "understanding", "representation", "negotiation", "arrangement", "communication", "warranty", "warranties", "discussion", "correspondence", "dealings", "proposal", "undertaking")
CONSEQUENCES = (
    "indemnify", "indemnity", "indemnification", "liable", "liability", "penalty", "penalties", "liquidated damages", "terminate", "termination",
    "breach", "default", "forfeit", "forfeiture", "waive", "waiver", "exclusive", "assign", "assignment", "confidential", "confidentiality",
    "arbitration", "jurisdiction", "governing law", "auto-renew", "automatically renew", "renewal",
)
STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is",
    "are", "was", "were", "be", "been", "being", "it", "its", "their", "any", "all", "such", "shall", "must", "may", "can", "will", "would",
    "should", "not", "no", "which", "who", "whom", "there", "here", "than", "then", "into", "upon", "under", "over", "out", "up", "down", "so",
    "if", "unless", "when", "where", "while", "during", "after", "before", "each", "either", "neither", "both", "other", "same", "own", "only",
    "also", "however", "provided", "subject", "required", "entitled", "permitted", "obliged", "obligated", "have", "has", "had", "do", "does",
)
ABBREVIATIONS = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "hon", "messrs", "sr", "jr", "inc", "ltd", "llc", "llp", "plc", "co", "corp", "pty", "gmbh", "ag",
    "nv", "bv", "sarl", "spa", "pvt", "kg", "sa", "cie", "assn", "bros", "no", "nos", "art", "arts", "sec", "secs", "cl", "para", "paras",
    "sched", "sch", "ann", "app", "exh", "fig", "ch", "cap", "reg", "regs", "vol", "pp", "ibid", "cf", "seq", "al", "etc", "viz",
    "approx", "est", "dept", "govt", "univ", "mfg", "vs", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
CROSS_REFERENCE = (
    r"\b(?:section|clause|article|exhibit|schedule|annex|appendix|attachment|paragraph|subsection)\s+"
    r"(?:\(\s*[a-z0-9]{1,4}\s*\)|\d[\d.]*|[a-z]\b|[ivx]{1,5}\b|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b)"
)
#: Issues that contradict, in the order of the decision table.
CONTRADICTIONS = ("value_not_in_evidence", "negation_dropped", "negation_added", "modality_changed", "actor_role_reversed", "time_direction_changed")
#: Shares of a claim's content words: to be established at all, and to be the same statement.
ESTABLISHED, SAME = 0.5, 0.6

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "′": "'", "″": '"', "–": "-", "—": "-", "―": "-", "−": "-", "…": "..."}
ZERO_WIDTH = "​‌‍﻿­"

#: A text without characters from U+0300 on is composed already.
MAY_COMPOSE = r"[^\x00-\u02FF]"

CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

TOPICS = {
    "parties": ("parties", "party", "roles", "role", "appointment", "engagement"),
    "term": ("term", "duration", "renewal", "renew", "commencement", "expiry", "expiration"),
    "fees": ("fees", "fee", "payment", "payments", "price", "pricing", "invoice", "invoicing", "charges", "remuneration", "expenses", "interest"),
    "termination": ("termination", "terminate", "cancellation", "breach", "default"),
    "confidentiality": ("confidentiality", "confidential", "nondisclosure", "secrecy", "privacy", "data"),
    "liability": ("liability", "liabilities", "indemnity", "indemnification", "indemnities", "warranty", "warranties", "insurance"),
    "notices": ("notices", "notice", "communications"),
    "governing_law": ("governing", "jurisdiction", "arbitration", "disputes", "dispute", "venue"),
}
TOPIC_PHRASES = (
    ("governing law", "governing_law"), ("applicable law", "governing_law"), ("dispute resolution", "governing_law"), ("limitation of liability", "liability"),
    ("intellectual property", "other"), ("force majeure", "other"), ("term and renewal", "term"), ("payment terms", "fees"),
)


def cardinals() -> dict[str, int]:
    """Number words from one to ninety-nine; compounds with a hyphen or a blank."""
    out = {w: k for k, w in enumerate(UNITS + TEENS, 1)}
    for k, ten in enumerate(TENS, 2):
        out[ten] = 10 * k
        out |= {f"{ten}{sep}{w}": 10 * k + u for u, w in enumerate(UNITS, 1) for sep in "- "}
    return out


def months() -> dict[str, int]:
    """Month names and their short forms."""
    out = {m: k for k, m in enumerate(MONTHS, 1)}
    return out | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
