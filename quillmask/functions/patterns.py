"""The patterns of identifiers. (?U) gives classes and boundaries their Unicode meaning, (?Ui) ignores case too.

A lookahead in front names the characters that a match may begin with. It changes no match; it is tried first, since boundaries and
alternatives are costly at every character of a text."""

from __future__ import annotations

# Australian phone numbers; dotted forms must not lie within a longer run of digits.
PHONES = [
    r"\+61[\s\-]*4\d{2}[\s\-]*\d{3}[\s\-]*\d{3}",
    r"\+61[\s\-]*[2-478][\s\-]*\d{4}[\s\-]*\d{4}",
    r"0[2-478][\s\-]*\d{4}[\s\-]*\d{4}",
    r"(?<!\d\.)0[2-478]\.\d{4}\.\d{4}(?!\d)",
    r"\(0[2-478]\)[\s\-]*\d{4}[\s\-]*\d{4}",
    r"04\d{2}[\s\-]*\d{3}[\s\-]*\d{3}",
    r"(?<!\d\.)04\d{2}\.\d{3}\.\d{3}(?!\d)",
    r"04\d{8}",
]
#: What every phone number holds.
PHONE_LEAD = r"\+61|0[2-478]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# Street types (all; those that need nothing after them; those that must end a phrase), units and states.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Lane|Ln|Way|Crescent|Cres|Boulevard|Blvd|Terrace|Tce|Close|Cl|Grove|Gr|Highway|Hwy|Parade|Pde|Circuit|Cct|Loop|Rise|Vale|Mews|Esplanade|Esp"
STREETS_FREE = "Street|Road|Avenue|Drive|Lane|Crescent|Boulevard|Terrace|Highway|Parade|Circuit|Esplanade|Mews"
STREETS_ENDING = "St|Rd|Ave|Dr|Ln|Cres|Blvd|Tce|Hwy|Pde|Cct|Court|Place|Close|Grove|Way|Rise|Vale|Loop|Ct|Pl|Cl|Gr"
UNIT = r"(?:(?:Unit|Flat|Apt|Apartment)\s+)?(?:\d+[A-Za-z]?\s*/\s*)?"
STATES_SHORT = "VIC|NSW|QLD|SA|WA|TAS|NT|ACT"
STATES = STATES_SHORT + "|Victoria|New South Wales|Queensland|South Australia|Western Australia|Tasmania|Northern Territory|Australian Capital Territory"
STREET_LEAD = r"\d+\s+[A-Z][A-Za-z]*(?:\s+(?!(?:The|On|In|At|Of|And|To|For|A|An)\b)[A-Z][A-Za-z]*){0,1}\s+"


def full_address(states: str = STATES) -> str:
    # a number is tried from its first digit alone, or from where the last match ended: what fails there fails from its other digits
    return rf"(?=[UFA]|(?:\G|(?<!\d))\d){UNIT}\d+\s+[A-Za-z\s]+(?=[SRADCPLWBTGHVME])(?:{STREETS}),?\s+[A-Za-z\s]+,?\s+(?:{states})\s+\d{{4}}"


STREET_ONLY = rf"(?=[UFA\d])(?:\b{UNIT}{STREET_LEAD}(?:{STREETS_FREE})\b|\b{UNIT}{STREET_LEAD}(?:{STREETS_ENDING})(?=[,.]|\s*$))"

# Numbers that need a keyword (group 1 is the number where there is a group).
MEDICARE = r"(?=\d)\b\d{4}\s?\d{5}\s?\d\b"
CRN = r"(?=[A-Z\d])(?:\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}[A-Za-z]\b|\b[A-Z0-9]{9}\b)"
STUDENT_ID = r"(?=[A-Z])\b[A-Z]{3}\d{3,}\b"
NDIS = r"(?:ndis|participant)\s*(?:number|no\.?|#)?\s*:?\s*(\d{9})\b"
ABN = r"abn\s*:?\s*(\d{2}\s?\d{3}\s?\d{3}\s?\d{3})\b"
PASSPORT = r"passport\s*(?:number|no\.?|#)?\s*:?\s*([A-Z]\d{7})\b"

# Labels of a date of birth, in order, and the forms of a date.
DOB_LABELS = ["DOB", r"D\.O\.B\.", "Date of Birth", "Date of birth", "Born", "Birth Date"]
MONTHS = "(?=[JFMASOND])(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = [
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"\d{1,2}\.\d{1,2}\.\d{2,4}",
    r"\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?" + MONTHS + r"\s+\d{2,4}",
    MONTHS + r"\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{2,4}",
]

# Phone numbers of the page recogniser (no hyphens), with their scores.
PAGE_PHONES = [
    (r"\+61\s*4\d{2}\s*\d{3}\s*\d{3}", 0.85),
    (r"\+61\s*[2-478]\s*\d{4}\s*\d{4}", 0.85),
    (r"0[2-478]\s*\d{4}\s*\d{4}", 0.85),
    (r"(?<!\d\.)0[2-478]\.\d{4}\.\d{4}(?!\d)", 0.85),
    (r"\(0[2-478]\)\s*\d{4}\s*\d{4}", 0.85),
    (r"04\d{2}\s*\d{3}\s*\d{3}", 0.85),
    (r"(?<!\d\.)04\d{2}\.\d{3}\.\d{3}(?!\d)", 0.85),
    (r"04\d{8}", 0.80),
]

# A captured name of one or two words; what separates the words of a name in text read by a machine.
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?|[A-Z]{2,}(?:\s+[A-Z]{2,})?)"
SEPARATOR = r"[\s\-‐-―]"
EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"

# Paths that may hold names: Windows, network and Unix ones, quoted ones first.
PATHS = [
    r'"[A-Za-z]:\\[^"]*"', r"'[A-Za-z]:\\[^']*'", r"[A-Za-z]:\\\S+", r"\\\\\S+", r'"/[^"]*"', r"'/[^']*'",
    r"/(?:Users|home|Volumes|private|tmp|var|mnt|media)/\S+",
]
