"""Patterns, word lists, tables and messages that results depend on."""

# Reference patterns (Java syntax, Unicode and case-insensitive).
FLAGS = "(?iuU)"
ARTICLE_OF_LAW = r"(?:Article|άρθρο)\s+([0-9IVXL]+(?:[A-Z])?)\s+(?:of|του)\s+(?:the\s+)?(?:Law\s+|Νόμο?ü?\s+)?([0-9]+)"
ECLI = r"\bECLI:([A-Z]{2}):[A-Z0-9]{1,6}:[0-9]{4}:[A-Z0-9]{1,6}\b"
CASE_NUMBER = r"(?:Civil|Criminal|Appeal|Αγ\.|App\.)?\s*([0-9]{1,5})\s*/\s*([0-9]{4})"
BARE_LAW = r"\bLaw\s+([0-9]+)"
KEYED_ARTICLE = (
    r"(?:Article|άρθρο|αρ\.)\s*([0-9IVXLC]+[A-Za-z]?)\s+(?:of\s+)?(?:the\s+)?(?:Law\s+|Ν\W?\s*)([A-Za-z0-9_+\-]+)"
)
MENTION_ARTICLE = (
    r"(?:Άρθρο|άρθρο|Article|αρ\.)\s*\.?\s*([0-9IVXLC]+(?:[A-Z])?)(?:\((\d+[a-z]?)\))?(?:\(([α-ω])\))?"
)
MENTION_CHAPTER = r"(?:ΚΕΦ\.|Κεφ\.|Κεφάλαιο|Chapter)\s*([0-9]+)"
MENTION_LAW = r"(?:Ν\.\s*|Law\s+|Νόμος\s+)?([0-9]+)(?:\(([IVXLC]+)\))?\s*/\s*([0-9]{4})"
MENTION_CASE = r"([0-9]{1,5})\s*/\s*([0-9]{4})"
ARTICLE_HEADING = r"^\s*(?:Article|Άρθρο)\s+([0-9IVXLC]+(?:[A-Z]|\(\d+\))*)(?:\.|\b)"
PARAGRAPH_HEADING = r"^\s*\(([0-9]+[a-z]?)\)\b"
PARAGRAPH_HEADING_LOOSE = r"^\s*\(([0-9]+[a-z]?)\)"
CELEX = r"^[1-4]\d{2}\d{2}[LR]\d{4}$"
AMOUNT = r"[€£$]\s?(\d[\d,.]*)"
CAPITALISED_NAME = r"\b([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)*\s?)\b"
SLASH_DATE = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
QUERY_DATE = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b"
QUERY_MONTH_DATE = (
    r"\b(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+(20\d{2})\b"
)
QUERY_YEAR = r"\b(20\d{2})\b"

# Judgment headings and the section type each opens.
HEADINGS = {
    "facts": "facts",
    "the facts": "facts",
    "procedural history": "procedural_history",
    "issue": "issue",
    "issues": "issue",
    "the issue": "issue",
    "the issues": "issue",
    "party argument": "party_argument",
    "arguments": "party_argument",
    "legal analysis": "legal_analysis",
    "the law": "legal_analysis",
    "reasoning": "legal_analysis",
    "holding": "holding",
    "decision": "holding",
    "conclusion": "holding",
    "order": "order",
    "costs": "order",
    "separate opinion": "separate_opinion",
    "dissent": "separate_opinion",
}

# Remedy words looked for in an order.
REMEDIES = [
    "damages", "compensation", "injunction", "specific performance", "costs", "rescission", "repayment", "interest",
    "dismissed",
]

# Fact and event vocabulary.
NAME_STOP = [
    "The", "This", "That", "In", "On", "At", "By", "For", "Any", "Shall", "From", "Under", "Court", "Agreement",
    "Party", "Article", "Section", "Schedule", "Cyprus", "Each",
]
OBLIGATIONS = ["shall", "must", "agrees to", "is liable", "shall pay", "warrants", "undertakes"]
EVENT_VERBS = [
    "delivered", "signed", "commenced", "terminated", "filed", "appointed", "petitioned", "expired", "received",
    "paid",
]

# Issue suggested when one of its keywords occurs.
ISSUE_RULES = [
    (["insolven", "wound up", "liquidator", "bankrupt", "αφερεγγυ"],
     "Is the company insolvent and therefore liable to be wound up by the court?"),
    (["negligence", "duty of care", "negligent", "αμέλεια"],
     "Did the defendant owe and breach a duty of care towards the claimant?"),
    (["breach", "failed to", "default", "παραβίαση"],
     "Was there a breach of the parties' contractual obligations?"),
    (["damages", "compensation", "loss", "ζημία"],
     "What damages or compensation is the claimant entitled to recover?"),
    (["liable", "liability", "responsib", "ευθύν"],
     "Is the defendant liable to the claimant and on what legal basis?"),
    (["limitation", "time-barred", "παρεγράφ"],
     "Is the claim barred by the applicable limitation period?"),
    (["jurisdiction", "δικαιοδοσία"],
     "Does the court have jurisdiction to hear and determine the claim?"),
    (["specific performance", "injunction"],
     "Is an equitable remedy (specific performance / injunction) available and appropriate?"),
]

# Status sets.
APPROVED_REUSE = ["APPROVED_OPEN", "APPROVED_WITH_ATTRIBUTION", "APPROVED_API_ONLY"]
AMENDMENT_OPERATIONS = ["INSERT", "DELETE", "REPLACE", "RENUMBER", "REPEAL", "COMMENCE"]
TREATMENTS = ["FOLLOWS", "DISTINGUISHES", "APPROVES", "CRITICISES", "OVERRULES", "DISCUSSES"]
ADVERSE_TREATMENTS = ["DISTINGUISHES", "OVERRULES", "CRITICISES"]
CLASSIFICATIONS = ["unclassified", "supporting", "adverse", "neutral"]
SUGGESTIONS = ["supporting", "adverse", "neutral"]
REVIEW_STATES = ["accepted", "rejected"]
FEEDBACK_JUDGEMENTS = ["opened", "saved_as_authority", "rejected", "irrelevant", "adverse"]

# Public holidays as (month, day), plan features and limits.
HOLIDAYS = [(1, 1), (1, 6), (3, 25), (12, 25), (12, 26)]
FEATURES = {
    "AI_REMOTE": ["pro", "enterprise"],
    "SEMANTIC_SEARCH": ["pro", "enterprise"],
    "FIRM_KNOWLEDGE": ["standard", "pro", "enterprise"],
    "DRAFTING": ["standard", "pro", "enterprise"],
    "ADVANCED_SEARCH": ["pro", "enterprise"],
}
UNLIMITED_PLANS = ["pro", "enterprise"]
FREE_LIMITS = {"search_per_day": 25, "saved_authorities": 20, "matters": 2}

# Structural terms per jurisdiction and level.
NODE_TERMS = {
    "CY": {"1": "LAW", "2": "PART", "3": "CHAPTER", "4": "ARTICLE", "5": "SUBARTICLE", "6": "PARAGRAPH"},
    "UK": {"1": "ACT", "2": "PART", "3": "Section", "4": "Subsection", "5": "Paragraph"},
    "EU": {"1": "REGULATION", "2": "TITLE", "3": "ARTICLE", "4": "PARAGRAPH", "5": "SUB-PARAGRAPH"},
}

# Accent folding, one character to one character.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿάέήίόύώϊϋΐΰ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyyαεηιουωιυιυ"

# Ranking constants and messages.
RRF_K = 60
EXACT_SCORE = 100.0
EXACT_BONUS = 1000.0
FUSION_NOTE = "BM25 + dense + tree/graph fusion (RRF)"
NO_HOLDING = "(no extractive holding text available)"
NOT_ANSWERED = (
    "No sufficiently supported authority was found for this question in the curated/verified corpus. "
    "No case, statute, or holding is asserted."
)
UNSUPPORTED = "No sufficiently supported authority was found for this question in the curated public corpus."
NO_VERBATIM = "(No verbatim content available from the top authority.)"
