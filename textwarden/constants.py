"""Tables and thresholds that results depend on, stated plainly."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------
CATEGORIES = (
    "insult/harassment",
    "obscenity/profanity",
    "hate/targeted group",
    "threat/violence",
    "sexual content",
    "bullying/taunting",
    "self-harm encouragement",
    "spam/scam",
)
DECISIONS = ("allow", "review", "block")
SEVERITIES = ("low", "medium", "high", "critical")
CRITICAL_CATEGORIES = ("threat/violence", "self-harm encouragement", "hate/targeted group")
LANGUAGE_HINTS = ("en", "hi", "hi-Latn", "bn", "te", "ta", "mr", "gu", "kn", "ml", "pa", "or")

ZERO_WIDTH = (
    "​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿￹￺￻"
)
HOMOGLYPHS_FROM = "аАеЕоОрРсСхХуУкКнНмМтТ" + "αΑβΒεΕοΟρΡτΤυΥχΧ"
HOMOGLYPHS_TO = "aAeEoOpPcCxXyYkKhHmMtT" + "aAbBeEoOpPtTyYxX"
ASTRAL_HOMOGLYPHS = {"𝐚": "a", "𝐀": "A", "𝑎": "a", "𝐴": "A", "𝒂": "a", "𝑨": "A", "𝓪": "a", "𝓐": "A"}
DIACRITICS_FROM = "àáâãäåÀÁÂÃÄÅçÇèéêëÈÉÊËìíîïÌÍÎÏñÑòóôõöøÒÓÔÕÖØùúûüÙÚÛÜýÿÝŸāăąĀĂĄćĉċčĆĈĊČďđĎĐēĕėęěĒĔĖĘĚ"
DIACRITICS_TO = "aaaaaaAAAAAAcCeeeeEEEEiiiiIIIInNooooooOOOOOOuuuuUUUUyyYYaaaAAAccccCCCCddDDeeeeeEEEEE"
LIGATURES = {"æ": "ae", "Æ": "AE"}
PUNCTUATION_FROM = "“”‘’«»‹›–—―‒`" + (
    "              　"
)
PUNCTUATION_TO = "\"\"''\"\"''----'" + " " * 15
ELLIPSIS = "…"

LEET_PATTERNS = {
    "f*ck": "fuck",
    "sh!t": "shit",
    "@ss": "ass",
    "b!tch": "bitch",
    "d@mn": "damn",
    "!d!0t": "idiot",
    "m0r0n": "moron",
    "5tup!d": "stupid",
}
LEET_CHARS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "!": "i", "$": "s", "+": "t"}
PHONETIC = {"ph": "f", "ck": "k", "qu": "kw", "x": "ks"}
SUBSTITUTIONS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "!": "i", "@": "a", "$": "s", "+": "t",
    "()": "o", "|-|": "h", "|_|": "u", "\\/": "v", "\\/\\/": "w", "><": "x",
}
LEET_SIGNS = "@!$+0135478"
VARIANT_LEET = {"a": "@4", "e": "3", "i": "!1", "o": "0", "s": "$5", "t": "+7", "b": "8"}
VARIANT_ELONGATED = "aeiouflrs"
VARIANT_PHONETIC = {"f": "ph", "k": "ck", "c": "k", "s": "z"}

SCRIPTS = {
    "devanagari": (0x0900, 0x097F),
    "bengali": (0x0980, 0x09FF),
    "gurmukhi": (0x0A00, 0x0A7F),
    "gujarati": (0x0A80, 0x0AFF),
    "oriya": (0x0B00, 0x0B7F),
    "tamil": (0x0B80, 0x0BFF),
    "telugu": (0x0C00, 0x0C7F),
    "kannada": (0x0C80, 0x0CFF),
    "malayalam": (0x0D00, 0x0D7F),
    "latin": (0x0020, 0x007F),
}
HINGLISH = (
    r"\b(hai|kar|kya|aur|main|tu|yaar|bhai|dude|yeh|woh|kuch|koi)\b",
    r"\b(achha|theek|sahi|galat|bas|abhi|phir|kal|aaj|raat)\b",
    r"\b(paisa|rupee|ghar|office|school|college|job|kaam)\b",
    r"\b(kaise|kaisa|kaisi|kyun|kyunki|lekin|matlab|samjha)\b",
    r"\b(dekho|dekh|suno|sun|bolo|bol|chal|chalo|aao)\b",
    r"\b\w+\s+(hai|hain|tha|thi|the|hoga|hogi|honge)\b",
    r"\b(very|really|totally|super)\s+\w*(achha|sahi|galat|bura)\b",
)
ROMANIZED = (r"\b\w*[aeiou]{2,}\w*\b", r"\b\w*[kg]h\w*\b", r"\b\w*[td]h\w*\b")

#: Kind, mask, pattern; the order is that of masking.
PII_PATTERNS = (
    ("emails", "[EMAIL]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phones", "[PHONE]", r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}"),
    ("phones", "[PHONE]", r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"),
    ("phones", "[PHONE]", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("phones", "[PHONE]", r"\b[6-9]\d{9}\b"),
    ("ids", "[ID]", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("ids", "[ID]", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("ids", "[ID]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_cards", "[CARD]", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    (
        "ip_addresses",
        "[IP]",
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    ),
)

#: lang, category, severity, weight, script, context_required, terms
LEXICON = (
    ("en", "insult/harassment", "medium", 0.8, None, False, ("idiot", "stupid", "moron", "dumb", "fool")),
    ("en", "insult/harassment", "high", 0.9, None, False, ("bastard", "bitch", "asshole")),
    ("en", "obscenity/profanity", "low", 0.6, None, False, ("damn", "hell", "crap")),
    ("en", "obscenity/profanity", "high", 0.95, None, False, ("fuck", "shit", "fucking")),
    ("en", "hate/targeted group", "high", 0.9, None, False, ("racist", "bigot", "nazi")),
    ("en", "threat/violence", "critical", 0.95, None, True, ("kill", "murder", "die", "death")),
    ("en", "threat/violence", "high", 0.85, None, False, ("beat up", "destroy", "eliminate")),
    ("en", "sexual content", "medium", 0.7, None, True, ("sex", "sexual", "porn", "nude")),
    ("hi", "insult/harassment", "medium", 0.8, None, False, ("बेवकूफ", "मूर्ख", "गधा", "उल्लू")),
    ("hi", "insult/harassment", "high", 0.9, None, False, ("कमीना", "हरामी", "साला", "कमीने", "kameena")),
    ("hi", "obscenity/profanity", "medium", 0.7, None, False, ("भैंस", "कुत्ता", "सुअर")),
    ("hi", "obscenity/profanity", "critical", 0.95, None, False, ("रंडी", "भोसड़ी", "मादरचोद", "मदरचोद", "मादरचोद्")),
    ("hi", "insult/harassment", "medium", 0.8, "romanized", False, ("bewakoof", "gadha", "ullu")),
    ("hi", "insult/harassment", "high", 0.9, "romanized", False, ("kamina", "harami", "saala")),
    ("hi", "obscenity/profanity", "critical", 0.95, "romanized", False, ("madarchod", "bhosadi", "randi")),
)
#: lang, pattern, category, severity, weight
LEXICON_PATTERNS = (
    ("en", "f+u+c+k+", "obscenity/profanity", "high", 0.8),
    ("en", "s+h+i+t+", "obscenity/profanity", "high", 0.8),
    ("en", "@ss", "obscenity/profanity", "medium", 0.8),
    ("en", "b!tch", "insult/harassment", "high", 0.8),
)
#: kind, sign or pattern, category, severity, weight, context_required
EMOJI = (
    ("offensive", "🖕", "insult/harassment", "high", 0.9, False),
    ("offensive", "🍆", "sexual content", "medium", 0.7, True),
    ("offensive", "🍑", "sexual content", "medium", 0.7, True),
    ("offensive", "💩", "obscenity/profanity", "low", 0.5, False),
    ("anger", "😡", "threat/violence", "low", 0.4, False),
    ("anger", "🤬", "obscenity/profanity", "medium", 0.6, False),
    ("anger", "💀", "threat/violence", "medium", 0.6, True),
    ("anger", "🔪", "threat/violence", "high", 0.8, False),
    ("anger", "🔫", "threat/violence", "high", 0.8, False),
    ("combination", "🖕.*you", "insult/harassment", "high", 0.95, False),
    ("combination", "kill.*💀", "threat/violence", "critical", 0.95, False),
    ("combination", "🍆.*🍑", "sexual content", "high", 0.85, False),
    ("kaomoji", "凸", "insult/harassment", "medium", 0.7, False),
    ("kaomoji", "ಠ_ಠ", "insult/harassment", "low", 0.3, False),
)

NEGATIONS = (
    "not", "no", "never", "nothing", "nobody", "nowhere", "neither", "nor", "none", "without", "lack", "lacking",
    "absent", "missing", "refuse", "deny", "reject", "avoid", "prevent", "stop", "cease", "quit", "discontinue",
    "cancel", "eliminate", "remove",
)
HINDI_NEGATIONS = (
    "नहीं", "न", "ना", "मत", "कभी नहीं", "कुछ नहीं", "कोई नहीं", "nahi", "nahin", "na", "mat", "kabhi nahi",
    "kuch nahi", "koi nahi", "bilkul nahi", "बिल्कुल नहीं",
)
NEGATION_PREFIXES = ("un", "in", "im", "ir", "il", "dis", "mis", "non", "anti")
NEGATION_SUFFIXES = ("less", "free")

REPORTING = (
    "said", "says", "told", "tells", "mentioned", "stated", "claimed", "reported", "according to", "as per", "quoted",
    "cited", "alleged", "supposedly", "apparently", "reportedly",
    "कहा", "बोला", "बताया", "कहते हैं", "के अनुसार", "के मुताबिक",
    "kaha", "bola", "bataya", "kehte hain", "ke anusar", "ke mutabik",
)
THIRD_PARTY = (
    r"\b(?:he|she|they|someone|somebody)\s+(?:said|told|mentioned)",
    r"\b(?:according to|as per)\s+\w+",
    r"\b(?:वह|वे|कोई)\s+(?:कहा|बोला|बताया)",
    r"\b(?:के अनुसार|के मुताबिक)\s+\w+",
)

SAFE_CONTEXTS = {
    "hr_reporting": (
        "hr report", "incident report", "harassment complaint", "workplace investigation", "employee complaint",
        "disciplinary action", "policy violation", "misconduct report", "grievance", "whistleblower",
        "compliance report", "investigation findings", "witness statement", "formal complaint", "workplace harassment",
        "discrimination report", "safety incident", "workplace violence", "hostile work environment",
        "शिकायत", "रिपोर्ट", "जांच", "कार्यस्थल", "उत्पीड़न", "भेदभाव",
        "shikayat", "report", "jaanch", "karyasthal", "utpeedan", "bhedbhav",
    ),
    "educational": (
        "training material", "educational content", "awareness program", "sensitivity training",
        "example of inappropriate", "what not to say", "inappropriate behavior example", "case study",
        "training scenario", "role play", "simulation", "workshop material", "policy training", "compliance training",
        "diversity training", "inclusion training", "anti-harassment training", "prevention program",
        "प्रशिक्षण", "शिक्षा", "जागरूकता", "उदाहरण", "केस स्टडी",
        "prashikshan", "shiksha", "jagrukta", "udaharan",
    ),
    "legal_documentation": (
        "legal document", "court filing", "deposition", "testimony", "evidence", "legal brief", "case law", "statute",
        "regulation", "policy document", "terms of service", "user agreement", "privacy policy", "code of conduct",
        "compliance documentation", "audit report", "regulatory filing",
        "कानूनी", "न्यायालय", "साक्ष्य", "गवाही", "दस्तावेज",
        "kanooni", "nyayalay", "sakshya", "gavahi", "dastavez",
    ),
    "research_academic": (
        "research study", "academic paper", "thesis", "dissertation", "survey data", "interview transcript",
        "focus group", "ethnographic study", "content analysis", "linguistic research", "social media study",
        "behavioral research", "psychological study", "sociological research",
        "अनुसंधान", "अध्ययन", "शोध", "सर्वेक्षण", "साक्षात्कार",
        "anusandhan", "adhyayan", "shodh", "sarvekshan", "sakshatkaar",
    ),
    "journalism": (
        "news report", "journalism", "press release", "media coverage", "breaking news", "investigative report",
        "news article", "editorial", "opinion piece", "correspondent report", "field report", "exclusive story",
        "समाचार", "पत्रकारिता", "रिपोर्ट", "मीडिया", "खबर",
        "samachar", "patrakarita", "report", "media", "khabar",
    ),
}
SAFE_WEIGHTS = {"hr_reporting": 0.8, "educational": 0.7, "legal_documentation": 0.6, "research_academic": 0.5, "journalism": 0.4}

#: category: sensitivity to negation, quotation, safe context
SENSITIVITY = {
    "threat/violence": (0.8, 0.7, 0.9),
    "hate/targeted group": (0.7, 0.6, 0.8),
    "insult/harassment": (0.6, 0.5, 0.7),
    "obscenity/profanity": (0.4, 0.3, 0.6),
    "sexual content": (0.5, 0.4, 0.8),
    "bullying/taunting": (0.6, 0.5, 0.7),
    "self-harm encouragement": (0.9, 0.8, 0.9),
}
DEFAULT_SENSITIVITY = (0.6, 0.5, 0.7)

#: category: threshold to predict it, class weight, severity weight in span ranking
CATEGORY_HEAD = {
    "insult/harassment": (0.4, 1.0, 0.6),
    "obscenity/profanity": (0.3, 1.0, 0.7),
    "hate/targeted group": (0.2, 2.0, 0.9),
    "threat/violence": (0.2, 3.0, 1.0),
    "sexual content": (0.4, 1.2, 0.8),
    "bullying/taunting": (0.4, 1.0, 0.5),
    "self-harm encouragement": (0.2, 2.5, 0.95),
    "spam/scam": (0.6, 0.8, 0.3),
}
DECISION_HEAD = {"allow": (0.6, 1.0), "review": (0.3, 1.5), "block": (0.4, 2.0)}
#: severity: threshold, class weight, prior factor
SEVERITY_HEAD = {"low": (0.5, 1.0, 1.0), "medium": (0.4, 1.2, 0.8), "high": (0.3, 1.5, 0.6), "critical": (0.2, 2.0, 0.4)}

#: tenant: category: thresholds for medium, high, critical; "*" is the base policy
POLICY_THRESHOLDS = {
    "*": {
        "threat/violence": (0.7, 0.5, 0.3),
        "hate/targeted group": (0.8, 0.6, 0.4),
        "obscenity/profanity": (0.85, 0.7, 0.5),
        "insult/harassment": (0.8, 0.65, 0.45),
        "sexual content": (0.8, 0.6, 0.4),
        "bullying/taunting": (0.85, 0.7, 0.5),
        "self-harm encouragement": (0.7, 0.5, 0.3),
        "spam/scam": (0.9, 0.8, 0.6),
    },
    "tech_corp": {
        "threat/violence": (0.6, 0.4, 0.2),
        "hate/targeted group": (0.7, 0.5, 0.3),
        "obscenity/profanity": (0.9, 0.8, 0.6),
        "insult/harassment": (0.85, 0.7, 0.5),
    },
}
POLICY_SAFE_CONTEXTS = {
    "*": ("hr_reporting", "legal_documentation", "educational_content", "policy_discussion"),
    "tech_corp": ("code_review", "technical_discussion", "debugging_session", "security_analysis"),
}
#: tenant, department, flags, shift of the review threshold
POLICY_DEPARTMENTS = (
    ("*", "hr", ("allow_sensitive_discussions",), -0.1),
    ("*", "legal", ("allow_policy_examples",), -0.15),
    ("*", "security", ("allow_threat_analysis",), 0.0),
    ("tech_corp", "engineering", ("allow_technical_language",), -0.1),
    ("tech_corp", "security", ("allow_threat_analysis", "allow_vulnerability_discussion"), -0.2),
    ("tech_corp", "hr", ("allow_sensitive_discussions",), -0.05),
)
#: tenant, category, severity, action, override_allowed
POLICY_HARD_RULES = (
    ("*", "threat/violence", "critical", "block", False),
    ("*", "hate/targeted group", "critical", "block", False),
    ("tech_corp", "threat/violence", "critical", "block", False),
    ("tech_corp", "hate/targeted group", "critical", "block", False),
    ("tech_corp", "spam/scam", "high", "block", True),
)
POLICY_CONTEXT_PATTERNS = {
    "hr_reporting": (
        r"hr\s+report", r"harassment\s+complaint", r"workplace\s+incident", r"employee\s+grievance",
        r"disciplinary\s+action", r"investigation\s+report",
    ),
    "legal_documentation": (
        r"legal\s+brief", r"court\s+filing", r"evidence\s+documentation", r"case\s+study", r"legal\s+precedent",
        r"statute\s+reference",
    ),
    "educational_content": (
        r"training\s+material", r"educational\s+example", r"awareness\s+campaign", r"policy\s+training",
        r"compliance\s+education", r"sensitivity\s+training",
    ),
    "policy_discussion": (
        r"policy\s+review", r"guideline\s+discussion", r"rule\s+clarification", r"procedure\s+update",
        r"compliance\s+meeting", r"governance\s+discussion",
    ),
}
SCRIPT_LANGUAGES = {
    "devanagari": (("hi", 0.8), ("mr", 0.2)),
    "bengali": (("bn", 0.9), ("as", 0.1)),
    "tamil": (("ta", 1.0),),
    "telugu": (("te", 1.0),),
    "kannada": (("kn", 1.0),),
    "malayalam": (("ml", 1.0),),
    "gujarati": (("gu", 1.0),),
    "oriya": (("or", 1.0),),
    "gurmukhi": (("pa", 1.0),),
}
#: n-grams of English and of romanized Hindi with their usual shares
NGRAMS = {
    "en": {
        "the": 0.027, " th": 0.025, "he ": 0.022, "ing": 0.020, "and": 0.018, "ion": 0.016, "tio": 0.015, "ent": 0.014,
        "ati": 0.013, "for": 0.012, "ted": 0.011, "ter": 0.011, "hat": 0.010, "tha": 0.010, "ere": 0.010, "ate": 0.009,
        "his": 0.009, "con": 0.009, "res": 0.008, "ver": 0.008, "th": 0.031, "he": 0.028, "in": 0.023, "er": 0.020,
        "an": 0.020, "ed": 0.017, "nd": 0.017, "to": 0.016, "en": 0.015, "ti": 0.014, "<t": 0.015, "e>": 0.012,
        "<a": 0.011, "s>": 0.010, "<i": 0.009,
    },
    "hi-Latn": {
        "hai": 0.025, "kar": 0.020, "kya": 0.018, "aur": 0.016, "mai": 0.015, "yeh": 0.014, "woh": 0.013, "bas": 0.012,
        "tha": 0.011, "hog": 0.010, "ach": 0.009, "sah": 0.008, "gal": 0.008, "thi": 0.007, "the": 0.007, "ga": 0.012,
        "gi": 0.011, "ge": 0.010, "na": 0.009, "ne": 0.008, "ni": 0.007, "ra": 0.007, "ri": 0.006, "re": 0.006, "ta": 0.006,
    },
}
TRANSLITERATION = {
    "hi": {
        "madarchod": "मदरचोद", "bhosadi": "भोसड़ी", "bhosdi": "भोसड़ी", "randi": "रंडी", "kamina": "कमीना", "kameena": "कमीना",
        "harami": "हरामी", "haramzada": "हरामज़ादा", "saala": "साला", "sala": "साला", "kutte": "कुत्ते", "kutta": "कुत्ता",
        "suar": "सुअर", "gadha": "गधा", "gadhe": "गधे", "bewakoof": "बेवकूफ", "bevakoof": "बेवकूफ", "ullu": "उल्लू", "pagal": "पागल",
        "paagal": "पागल", "aur": "और", "hai": "है", "hain": "हैं", "kar": "कर", "kya": "क्या", "main": "मैं", "tu": "तू", "tum": "तुम",
        "yaar": "यार", "bhai": "भाई", "dost": "दोस्त", "ghar": "घर", "paisa": "पैसा", "paise": "पैसे", "rupee": "रुपया",
        "rupaye": "रुपये", "achha": "अच्छा", "accha": "अच्छा", "theek": "ठीक", "thik": "ठीक", "sahi": "सही", "galat": "गलत",
        "bas": "बस", "abhi": "अभी", "phir": "फिर", "kal": "कल", "aaj": "आज",
    },
    "bn": {
        "sala": "শালা", "magir": "মাগীর", "magi": "মাগী", "khanki": "খানকী", "harami": "হারামী", "gadha": "গাধা", "pagol": "পাগল",
        "bewakoof": "বেওকুফ", "ami": "আমি", "tumi": "তুমি", "apni": "আপনি", "kemon": "কেমন", "achen": "আছেন", "bhalo": "ভালো",
        "kharap": "খারাপ", "bari": "বাড়ি", "taka": "টাকা",
    },
    "ta": {
        "naan": "நான்", "nee": "நீ", "avan": "அவன்", "aval": "அவள்", "enna": "என்ன", "epdi": "எப்படி", "veettu": "வீட்டு",
        "panam": "பணம்", "nalla": "நல்ல", "ketta": "கெட்ட",
    },
}
SPELLING_VARIANTS = {
    "ph": "f", "bh": "b", "th": "t", "dh": "d", "kh": "k", "gh": "g", "ch": "c", "jh": "j", "aa": "a", "ii": "i", "uu": "u",
    "ee": "e", "oo": "o", "w": "v", "z": "j", "x": "ks",
}
EMOJI_CONTEXT = {
    "profanity": ("fuck", "shit", "damn", "hell", "ass", "bitch", "bastard", "crap", "piss", "bloody"),
    "violence": ("kill", "murder", "die", "death", "hurt", "pain", "beat", "fight", "attack", "destroy", "violence"),
    "sexual": ("sex", "sexual", "porn", "nude", "naked", "breast", "penis", "vagina", "orgasm", "masturbate", "horny"),
    "harassment": ("hate", "stupid", "idiot", "loser", "ugly", "fat", "worthless", "pathetic", "disgusting", "freak"),
}
CONTEXT_SENTENCES = {
    "has_negation": "Negation detected - content may be discussing what NOT to do",
    "has_quotation": "Quoted content detected - may be reporting or referencing others",
    "hr_reporting": "HR reporting context detected",
    "educational": "Educational/training content detected",
    "legal_documentation": "Legal documentation context detected",
    "research_academic": "Research/academic context detected",
    "journalism": "Journalism/news reporting context detected",
}
ACTION_SENTENCES = {
    "allow": "Context analysis suggests content is likely appropriate",
    "review": "Context analysis suggests manual review recommended",
}
#: What logs must not show, in the order in which it is masked.
LOG_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "indian_phone": r"(\+91[-.\s]?)?[6-9]\d{9}",
    "credit_card": r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "aadhaar": r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "url": r"https?://[^\s<>\"{}|\\^`\[\]]+",
    "api_key": r"\b[A-Za-z0-9]{32,}\b",
}
# --- end of fixed values ----------------------------------------------------------

#: Capital and small fullwidth letters follow their ASCII counterparts at a fixed distance.
FULLWIDTH_FROM = "".join(chr(0xFF21 + i) + chr(0xFF41 + i) for i in range(26))
FULLWIDTH_TO = "".join(chr(0x41 + i) + chr(0x61 + i) for i in range(26))
