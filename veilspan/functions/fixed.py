"""Patterns, vocabularies, confidences and policies that results depend on.

Patterns are in Java's dialect with ASCII classes, as Spark's regexp functions read them.
"""

# Character shapes of the detected families.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b"
PHONE = r"(?<!\d)(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\d)"
PHONE_INTERNATIONAL = r"(?<!\d)\+\d{1,3}[\s.\-]?(?:\(\d{1,4}\)[\s.\-]?)?\d{2,4}(?:[\s.\-]?\d{2,4}){1,4}(?!\d)"
SSN_DASHED = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
SSN_SPACED = r"(?<!\d)\d{3}[ ]\d{2}[ ]\d{4}(?!\d)"
GOV_ID_GROUPED = r"(?<!\d)\d{3}[ \-]\d{3}[ \-]\d{3}(?!\d)"
GOV_ID_DOTTED = r"(?<!\d)\d{2,3}\.\d{2}\.\d{4}(?!\d)"
GOV_ID_PLAIN = r"(?<!\d)\d{9}(?!\d)"
CARD_CANDIDATE = r"(?<!\d)(?:\d[ \-]?){13,19}(?<=\d)"
GEO = r"\[-?\d{1,3}\.\d+,\s*-?\d{1,3}\.\d+\]"
HANDLE = r"(?<![\w@])@[A-Za-z][A-Za-z0-9_.]{2,29}\b"
MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE_MONTH_FIRST = rf"(?i)\b{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
DATE_DAY_FIRST = rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\.?,?\s+\d{{4}}\b"
DATE_NUMERIC = r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?\b"

# Emirates and Gulf shapes.
EMIRATES_ID = r"\b784-?\d{4}-?\d{7}-?\d\b"
UAE_MOBILE = r"(?<!\d)(?:\+971[\s\-]?|00971[\s\-]?|0)?5[0-9][\s\-]?\d{3}[\s\-]?\d{4}(?!\d)"
UAE_LANDLINE = r"(?<!\d)(?:\+971[\s\-]?|00971[\s\-]?)[2346789][\s\-]?\d{3}[\s\-]?\d{4}(?!\d)|(?<!\d)0[2346789][\s\-]?\d{3}[\s\-]?\d{4}(?!\d)"
UAE_PO_BOX = r"(?i)\bP\.?\s?O\.?\s?Box\s?\d{1,6}\b"
UAE_TRADE_LICENCE = r"\bCN-?\d{6,7}\b"
EMIRATE_NAME = r"(?i)\b(?:Dubai|Abu Dhabi|Sharjah|Ajman|Fujairah|Ras Al Khaimah|Umm Al Quwain)\b"
POSTAL_NUMBER = r"\b\d{3,6}\b"
# (type, pattern, checksum or none, base confidence), in order of precedence
GULF_IDS = (
    ("uae_emirates_id", r"\b784-?\d{4}-?\d{7}-?\d\b", "uae", 0.9),
    ("sa_iqama", r"\b2\d{9}\b", "saudi", 0.55),
    ("sa_national_id", r"\b1\d{9}\b", "saudi", 0.55),
    ("qa_qid", r"\b[23]\d{10}\b", None, 0.5),
    ("bh_cpr", r"\b\d{2}(?:0[1-9]|1[0-2])\d{5}\b", None, 0.4),
    ("kw_civil_id", r"\b[23]\d{11}\b", "kuwait", 0.55),
    ("om_civil_number", r"\b\d{8}\b", None, 0.3),
)
KUWAIT_WEIGHTS = (2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ARABIC_INDIC_DIGITS, EASTERN_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
# Arabic words that, once one prefix and then one suffix are stripped, mark an identity number nearby
ID_CUES = ("هوية", "بطاقة", "اقامة", "رقم", "جنسية", "مدني", "سجل")
CUE_PREFIXES = ("بال", "كال", "وال", "فال", "لل", "ال", "و", "ف", "ب", "ل", "ك")
CUE_SUFFIXES = ("هما", "كما", "تان", "تين", "ون", "ين", "ات", "ها", "هم", "هن", "نا", "كم", "كن", "ية", "ه", "ي", "ا")
ARABIC_WORD = "[ء-ي]+"

# Vocabularies.
ORG_SUFFIXES = r"Inc\.?|LLC|L\.L\.C\.|Corp\.?|Corporation|Ltd\.?|Co\.|Company|Group|Technologies|Labs|Partners|Holdings|Industries"
ORGANISATION = rf"\b[A-Z][A-Za-z0-9&'\-]*(?:\s+[A-Z][A-Za-z0-9&'\-]*){{0,4}}\s+(?:{ORG_SUFFIXES})\b"
CARD_ISSUER = r"\b(?:Mastercard|American Express|Diners Club International|Diners Club|JCB|UnionPay|China T-Union|RuPay|Interac)\b"
DEMOGRAPHIC = (
    r"\b(?:Male|Female|Non-binary|Nonbinary|Genderqueer|Genderfluid|Agender|Bigender|"
    r"Transgender|Trans(?:\s+(?:[Mm]an|[Ww]oman))?|Cisgender|Intersex|Two-Spirit)\b"
)
TITLE = (
    r"\b(?:Doctor|Professor|Manager|Director|Engineer|Analyst|Consultant|Officer|"
    r"President|Attorney|Barrister|Solicitor|Nurse|Teacher|Accountant|Architect|"
    r"Pharmacist|Surgeon|Physician|Dentist|Paralegal|Auditor|Technician|Supervisor|"
    r"Administrator|Coordinator|Specialist|Executive|Chairman|Chairwoman|Chairperson|"
    r"CEO|CFO|CTO|COO|Editor|Journalist|Reporter|Scientist|Researcher|Sergeant|"
    r"Captain|Lieutenant|Colonel|General|Judge|Magistrate)\b"
)
STREET_SUFFIXES = (
    r"Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|"
    r"Way|Place|Pl|Terrace|Circle|Cir|Square|Sq|Highway|Hwy"
)
STREET = (
    rf"\b(?:\d{{1,6}},?\s+)?[A-Z][A-Za-z0-9'.\-]*(?:\s+[A-Z][A-Za-z0-9'.\-]*){{0,4}}\s+(?:{STREET_SUFFIXES})\b\.?"
    r"(?:,?\s+[A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,2})?"
    r"(?:,?\s+[A-Z]{2,3})?"
    r"(?:,?\s+\d{5}(?:-\d{4})?)?"
    r"(?:,?\s+[A-Z]{1,2}\d[A-Z0-9]?\s?\d[A-Z]{2})?"
)
SALUTATION = r"(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr)\.?"
NAME_CUE = (
    r"\b(?i:my name is|i am|i'm|this is|call me|contact|reach out to|attn:?|"
    rf"signed|regards,?|from|{SALUTATION})\s+(?:{SALUTATION}\s+)?"
    r"([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,2})"
)
CAPITALIZED_WORDS = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
NO_NAME_STARTS = (
    "i", "im", "the", "my", "hi", "hello", "hey", "dear", "please", "thanks",
    "thank", "call", "is", "it", "this", "that", "you", "your", "we", "our",
)

# Fields named by a cue; group 1 is the value.
ALNUM_ID_CUE = (
    r"(?i)\b(?:id\s*card|passport|driver'?s?\s*licen[cs]e|licen[cs]e\s*number|"
    r"identification\s*number|national\s*id)\s*(?:number\s*)?(?:is|:)?\s*([A-Z]{1,2}\d{5,9}[A-Z]{0,2})"
)
USERNAME_CUE = r"(?i)\b(?:username|user\s*name|handle|login(?:\s+id)?|user\s*id)\s*(?:is|:)\s*([A-Za-z0-9][A-Za-z0-9_.\-]{2,29})"
ADDRESS_FIELD = (
    r"(?i)\b(?:Building|Street|City|State|Post\s*code|Country|Secondary\s*Address)\s*:\s*"
    r"(?:<strong>)?\*{0,2}([^\n<*]{1,50}?)\*{0,2}(?:</strong>)?\s*(?=<|\n|[,.;]|$)"
)
NAME_FIELD = (
    r"(?i)\b(?:First|Last|Middle|Given|Full)\s*Names?\s*\d{0,2}\s*:\s*"
    r"(?:<strong>)?\*{0,2}[\"']?([^\n<*\"']{1,50}?)[\"']?\*{0,2}(?:</strong>)?\s*(?=<|\n|[,.;\"]|$)"
)
NAME_TAG = r"(?i)<name>\s*([^<]{1,80}?)\s*</name>"

# Our own choice (there is no catalogue to follow): access keys and cued credentials, group 1 the value.
SECRET_ACCESS_KEY = r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b"
SECRET_CUED = r"(?i)\b(?:password|passwd|pwd|pass|token|secret|api[_\-]?key)\"?\s{0,2}[:=]\s{0,2}\"?([^\s\",;<>]{5,100})"
SECRET_TAG = r"(?i)<(?:password|secret|token)>\s{0,4}([^<\s]{3,100})\s{0,4}</"

# Ownership anchors "my <type> is <value>".
NEGATION = r"(?:not|never|no longer|isn'?t|wasn'?t|aren'?t|doesn'?t|didn'?t)"
COPULA = r"(?:is|was|are|isn'?t|wasn'?t|aren'?t)"
POSSESSIVE = r"(?:my|the|his|her|their|our|user'?s)"
ZONE_END = r"(?=[.!?](?:\s|$)|[;—–]|\n|$)"
VERB_NEGATION = r"(?:not|never|no longer|don'?t|doesn'?t|didn'?t)"
# (label, type words, value)
ANCHORS = (
    ("EMAIL", r"e-?mail(?:\s+address)?", EMAIL),
    ("PHONE", r"(?:phone|cell|mobile)(?:\s+number)?|number", PHONE),
    ("GOV_ID", r"ssn|social security(?:\s+number)?|national id|passport(?:\s+number)?", SSN_DASHED),
    ("CREDIT_CARD", r"(?:credit\s+card|card)(?:\s+number)?", CARD_CANDIDATE),
    ("PERSON", r"name", r"[A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,2}"),
    ("ADDRESS", r"address", r"\S(?:.*\S)?"),
    ("ADDRESS", None, r"\S(?:.*\S)?"),  # "live at", "reside at"
    ("USERNAME", r"username|handle|user\s*name|login(?:\s+id)?", r"@?[A-Za-z0-9][A-Za-z0-9_.\-]{2,29}"),
    ("DATE_TIME", r"date\s+of\s+birth|birth\s*date|birthday|dob", rf"{DATE_MONTH_FIRST}|{DATE_DAY_FIRST}|{DATE_NUMERIC}|{TIME}"),
)

# Sentences, normalization.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g",
    "i.e", "inc", "ltd", "co", "corp", "no", "approx", "fig", "u.s", "u.k",
)
SENTENCE_END = r"[.!?]+[\"')\]]*(?:\s+|$)"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
SPACED_RUN = r"(?<!\w)(?:\S ){3,}\S(?!\w)"

# Injection heuristics.
INJECTION_OVERRIDE = (
    r"(?i)\b(ignore|disregard|forget|override)\b.{0,25}\b(previous|prior|all|above|system|your)\b"
    r".{0,25}\b(instructions?|rules?|guidelines?|prompt)\b"
)
INJECTION_ROLEPLAY = (
    r"(?i)\b(you are now|act as if|pretend (you are|to be)|roleplay as|simulate being)\b.{0,40}"
    r"\b(no (restrictions|rules|filters|limits)|unrestricted|DAN|developer mode|no content policy)\b"
)
INJECTION_EXFILTRATION = (
    r"(?i)\b(reveal|print|show|output|repeat)\b.{0,25}\b(your |the )?"
    r"(system prompt|instructions|configuration|hidden|everything above)\b"
)
JUDGE_LOW, JUDGE_HIGH = 0.4, 0.8

# Difficulty signals.
HARD = (
    r"(?i)\b(prove|derive|optimi[sz]e|theorem|multi[\s-]?step|step[\s-]by[\s-]step|"
    r"design\s+a\s+system|system\s+design|architecture|distributed)\b"
)
MODERATE = (
    r"(?i)\b(def|class|function|write\s+(a|an)?\s*(code|program|script|function)|"
    r"solve|calculate|compute|equation|design|implement|build|refactor|"
    r"thread[\s-]?safe|async|concurren\w*|cache|algorithm|data\s?structure|"
    r"unit\s+test|error\s+handling)\b"
)
CONCURRENCY = r"(?i)\b(thread-safe|concurrent\w*|async)\b"
ROBUSTNESS = r"(?i)\b(unit\s+tests?|error\s+handling)\b"
LEADING_VERB = r"(?i)^\s*(design|implement)\b"
CONJUNCTION = r"(?i)\band\b"
CHOICES = r"(?s)\bA\)\s*\S.*\bB\)\s*\S.*\bC\)\s*\S"
MATH = r"\\(frac|sqrt|sum|prod|int|lim|binom|boxed|overline|angle|triangle|cdot)\b|[∑∫∏√∞≤≥≠≈±×÷]"
ROUTER_ANCHORS = {
    "simple": [
        "Hi, how are you?",
        "What is 2 plus 2?",
        "Say hello to my friend.",
        "Thanks so much!",
        "What's the capital of France?",
        "Good morning!",
    ],
    "moderate": [
        "Summarize this paragraph in three sentences.",
        "Explain how photosynthesis works.",
        "Write a short product description for a running shoe.",
        "Compare Python and JavaScript for web development.",
        "Draft a polite email declining a meeting invite.",
    ],
    "complex": [
        "Design a distributed rate limiter that handles clock skew across regions.",
        "Prove that the halting problem is undecidable.",
        "Write a multi-step migration plan from a monolith to microservices with a rollback strategy.",
        "Derive the gradient of a transformer's attention mechanism with respect to its query weights.",
        "Design a sovereignty-grade PII vault schema with TTL and right-to-erasure.",
    ],
}

# Label priorities, token format, markers.
PRIORITY = {
    "SECRET": 10, "CREDIT_CARD": 9, "GOV_ID": 8, "EMAIL": 7, "PHONE": 6, "IP_ADDRESS": 5, "DATE_TIME": 5,
    "USERNAME": 5, "ADDRESS": 4, "ORG": 3, "PERSON": 2, "TITLE": 2, "DEMOGRAPHIC": 1, "MISC": 1,
}
DIGIT_LABELS = ("PHONE", "CREDIT_CARD", "GOV_ID")
WORD_LABELS = ("PERSON", "ADDRESS", "ORG", "MISC", "USERNAME", "TITLE", "DEMOGRAPHIC")
TOKEN = r"<[A-Z_]+_PII_([0-9a-f]{10})>"
TOKEN_LENGTH = 28
UNRESOLVED, SUPPRESSED = "[UNRESOLVED_PII_TOKEN]", "[CONTEXT_SUPPRESSED]"
TOOL_TOKEN_PREFIX = "PII_"
TOKEN_NOTICE = (
    "Note: placeholders like <EMAIL_PII_...> or <PERSON_PII_...> stand in for "
    "real values. Answer directly and helpfully; preserve each placeholder "
    "verbatim, and never ask for the real value or call the message incomplete."
)

# The shipped policies, label -> (action, least confidence, action below it).
_REVERSIBLE, _PRESERVE, _BLOCK = ("REVERSIBLE", None, None), ("PRESERVE", None, None), ("BLOCK", None, None)
POLICIES = {
    "default": {
        "EMAIL": _REVERSIBLE, "PHONE": _REVERSIBLE, "IP_ADDRESS": _REVERSIBLE, "DATE_TIME": _REVERSIBLE, "USERNAME": _REVERSIBLE,
        "PERSON": ("REVERSIBLE", 0.6, "PRESERVE"), "ADDRESS": ("REVERSIBLE", 0.6, "PRESERVE"),
        "CREDIT_CARD": _BLOCK, "GOV_ID": _BLOCK, "SECRET": _BLOCK,
        "ORG": _PRESERVE, "TITLE": _PRESERVE, "DEMOGRAPHIC": _PRESERVE, "MISC": _PRESERVE,
    },
    "finance_strict": {
        "EMAIL": _REVERSIBLE, "PHONE": _REVERSIBLE, "DATE_TIME": _REVERSIBLE, "USERNAME": _REVERSIBLE,
        "PERSON": _REVERSIBLE, "ADDRESS": _REVERSIBLE,
        "IP_ADDRESS": _BLOCK, "CREDIT_CARD": _BLOCK, "GOV_ID": _BLOCK, "SECRET": _BLOCK, "DEMOGRAPHIC": _BLOCK,
        "ORG": _PRESERVE, "TITLE": _PRESERVE, "MISC": _PRESERVE,
    },
    "gulf_sovereign": {
        "EMAIL": _REVERSIBLE, "PHONE": _REVERSIBLE, "IP_ADDRESS": _REVERSIBLE, "DATE_TIME": _REVERSIBLE, "USERNAME": _REVERSIBLE,
        "PERSON": ("REVERSIBLE", 0.6, "PRESERVE"), "ADDRESS": ("REVERSIBLE", 0.6, "PRESERVE"),
        "CREDIT_CARD": _BLOCK, "SECRET": _BLOCK, "GOV_ID": ("BLOCK", 0.6, "PRESERVE"),
        "ORG": _PRESERVE, "TITLE": _PRESERVE, "DEMOGRAPHIC": _PRESERVE, "MISC": _PRESERVE,
    },
}
NEGATION_OVERRIDE = {"default": "PRESERVE", "finance_strict": None, "gulf_sovereign": "PRESERVE"}
COMPRESSIBLE_LENGTH = 20
# tool, argument -> action; anything else is preserved
TOOL_RULES = (("bash", "command", "BLOCK"), ("web_search", "query", "REVERSIBLE"), ("file_write", "path", "PRESERVE"), ("file_write", "content", "REVERSIBLE"))
