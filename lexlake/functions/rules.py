"""Rule tables.  The words, patterns, numbers and names below are fixed values
that the results depend on; the operators only interpret them."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """A lower-case regex and a literal that each of its matches contains."""

    regex: str
    needs: str


class LabelRule(NamedTuple):
    label: str
    min_confidence: float
    patterns: tuple[Pattern, ...]


P = Pattern

# Section labels, in order of precedence on ties.
LABEL_RULES = (
    LabelRule("obligation", 0.75, (
        P(r"\bshall\b", "shall"),
        P(r"\bmust\b", "must"),
        P(r"\bis required to\b", "is required to"),
        P(r"\bare required to\b", "are required to"),
        P(r"\bis obligated to\b", "is obligated to"),
        P(r"\bensure that\b", "ensure that"),
    )),
    LabelRule("prohibition", 0.80, (
        P(r"\bshall not\b", "shall not"),
        P(r"\bmust not\b", "must not"),
        P(r"\bmay not\b", "may not"),
        P(r"\bprohibited\b", "prohibited"),
        P(r"\bis not permitted\b", "is not permitted"),
        P(r"\bno person shall\b", "no person shall"),
        P(r"\bno organization shall\b", "no organization shall"),
    )),
    LabelRule("permission", 0.70, (
        P(r"\bmay\b(?!\s+not\b)", "may"),
        P(r"\bis entitled to\b", "is entitled to"),
        P(r"\bhas the right\b", "has the right"),
        P(r"\bis authorized to\b", "is authorized to"),
        P(r"\bis permitted to\b", "is permitted to"),
    )),
    LabelRule("definition", 0.85, (
        P(r"\bmeans\b", "means"),
        P(r"\bis defined as\b", "is defined as"),
        P(r"\binterpretation\b", "interpretation"),
    )),
    LabelRule("procedural", 0.65, (
        P(r"\bshall be filed\b", "shall be filed"),
        P(r"\bnotice shall be given\b", "notice shall be given"),
        P(r"\bwithin \d+ days\b", "within "),
        P(r"\bin the prescribed form\b", "in the prescribed form"),
        P(r"\bcoming into force\b", "coming into force"),
        P(r"\bapplication of\b", "application of"),
    )),
)
LABELS = tuple(r.label for r in LABEL_RULES)

# Severity of language, strongest first.
SEVERITY_RULES = {
    "punitive": (
        P(r"\boffence\b", "offence"),
        P(r"\bpenalt(?:y|ies)\b", "penalt"),
        P(r"\bfine\b", "fine"),
        P(r"\bimprisonment\b", "imprisonment"),
        P(r"\bbreach\b", "breach"),
        P(r"\bprohibited\b", "prohibited"),
        P(r"\bshall not\b", "shall not"),
        P(r"\bmust not\b", "must not"),
        P(r"\bsecurity safeguards?\b", "security safeguard"),
        P(r"\bnotif(?:y|ication)\b.*\bbreach\b", "breach"),
    ),
    "mandatory": (
        P(r"\bshall\b", "shall"),
        P(r"\bmust\b", "must"),
        P(r"\bis required\b", "is required"),
        P(r"\bobligation\b", "obligation"),
        P(r"\bconsent\b", "consent"),
        P(r"\bpurpose\b.*\bcollect", "collect"),
    ),
    "procedural": LABEL_RULES[4].patterns,
    "definitional": (
        P(r"\bmay\b", "may"),
        P(r"\bmeans\b", "means"),
        P(r"\bdefinition\b", "definition"),
        P(r"\binterpretation\b", "interpretation"),
        P(r"\bshort title\b", "short title"),
    ),
}
SEVERITIES = tuple(SEVERITY_RULES)

AREA_RULES = {
    "data_collection": (
        P(r"\bcollect", "collect"),
        P(r"\bgather", "gather"),
        P(r"\bobtain.*personal information", "personal information"),
    ),
    "consent": (P(r"\bconsent", "consent"), P(r"\bknowledge and consent", "knowledge and consent")),
    "data_use": (
        P(r"\buse\b.*personal information", "personal information"),
        P(r"\bpurpose.*\buse\b", "purpose"),
    ),
    "data_disclosure": (
        P(r"\bdisclos", "disclos"),
        P(r"\bshare.*personal information", "personal information"),
    ),
    "data_retention": (
        P(r"\bretain", "retain"),
        P(r"\bretention", "retention"),
        P(r"\bdestro", "destro"),
        P(r"\bdispos", "dispos"),
    ),
    "breach_notification": (
        P(r"\bbreach", "breach"),
        P(r"\bnotif.*breach", "breach"),
        P(r"\bsafeguard", "safeguard"),
    ),
    "access_rights": (
        P(r"\baccess\b.*personal information", "personal information"),
        P(r"\bright of access", "right of access"),
        P(r"\brequest.*access", "access"),
    ),
    "accountability": (
        P(r"\baccountab", "accountab"),
        P(r"\bdesignat.*officer", "officer"),
        P(r"\bresponsib", "responsib"),
    ),
}
AREAS = tuple(AREA_RULES)

# Residual risk of one obligation by severity and coverage status.
RISK_MATRIX = {
    "punitive": {"covered": "medium", "partial": "high", "gap": "critical"},
    "mandatory": {"covered": "low", "partial": "medium", "gap": "high"},
    "procedural": {"covered": "low", "partial": "low", "gap": "medium"},
    "definitional": {"covered": "low", "partial": "low", "gap": "low"},
}
RISK_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
COVERED_AT = 0.5
PARTIAL_AT = 0.35
SYNTHETIC_SCORE = {"covered": 0.85, "partial": 0.45, "gap": 0.15}

# Display order of the regulations known by name; others follow by id.
REGULATION_ORDER = (
    "pipeda",
    "privacy_act",
    "sor_2018_64_breach_of_security_safeguards_regulations",
    "sor_2001_7_pipeda_regulations",
    "opc__guidelines_for_obtaining_meaningful_consent",
    "opc__breach_of_security_safeguards_reporting",
    "opc__inappropriate_data_practices",
    "opc__privacy_and_ai",
    "opc__ten_fair_information_principles",
)

# Section segmentation.
HEADING_KEYWORDS = (
    "DEFINITIONS", "INTERPRETATION", "PURPOSE", "APPLICATION", "REQUIREMENTS", "OBLIGATIONS",
    "PROHIBITIONS", "EXEMPTIONS", "PENALTIES", "ENFORCEMENT", "COMING INTO FORCE", "SHORT TITLE",
    "REPORTING", "DISCLOSURE", "TRANSACTIONS", "RECORDS", "REGISTRATION",
)
TOC_PHRASES = (
    "table of provisions", "table of contents", "table analytique", "table des matières",
    "analytical table", "contents", "provisions",
)
CITATION = r"\b\d{4},\s*c\.\s*\d+(?:,\s*s\.\s*\d+)?"

# Short document names used as a title prefix, first hit wins.
PARENT_ACT_PREFIX = (
    (("money laundering",), "PCMLTFA"),
    (("bank act",), "Bank Act"),
    (("pipeda", "personal information"), "PIPEDA"),
)
ACT_ID_PREFIX = (
    ("proceeds_of_crime", "PCMLTFA"),
    ("bank_act", "Bank Act"),
    ("personal_information", "PIPEDA"),
    ("special_economic_measures", "SEMA"),
    ("magnitsky", "Magnitsky Law"),
    ("deposit_insurance", "CDIC Act"),
)
REGULATION_ID_PREFIX = (
    ("sor-2002-184", "PCMLTFA Regs"),
    ("sor-2001-317", "PCMLTFA STR"),
    ("sor-2002-412", "Cross-Border"),
    ("sor-2007-121", "MSB Registration"),
    ("sor-2007-292", "AMPs"),
    ("sor-2010-165", "Iran Sanctions"),
    ("sor-2014-58", "Russia Sanctions"),
    ("sor-2018-64", "PIPEDA Breach"),
    ("sor-2025-67", "Goods Reporting"),
)

# Taxonomy.
CATEGORIES = {
    "act": ("Acts (Primary Legislation)", "acts"),
    "regulation": ("Regulations (Secondary Legislation)", "regulations"),
    "guidance": ("Regulator Guidance", "guidance"),
    "policy": ("Company Policies", "company_policies"),
}
TITLE_PATTERNS = {
    "act": (r"Act$", r"^[A-Z].*Act$", r"S\.C\. \d{4}"),
    "regulation": (r"Regulations?$", r"Rules?$", r"SOR/"),
    "guidance": (r"Guideline", r"Advisory", r"Notice", r"^B-\d+", r"^E-\d+"),
}
CONTENT_PATTERNS = {
    "act": (r"Her Majesty", r"enactment", r"coming into force"),
    "regulation": (r"pursuant to", r"under section", r"Governor in Council"),
}
REGULATOR_KEYWORDS = {
    "OSFI": ("OSFI", "Superintendent", "Financial Institutions"),
    "FINTRAC": ("FINTRAC", "Money Laundering", "Terrorist Financing"),
    "OPC": ("OPC", "Privacy Commissioner", "Personal Information"),
    "FCAC": ("FCAC", "Consumer Agency", "Financial Consumer"),
}
ACT_KEYWORDS = {
    "Bank Act": ("Bank Act", "S.C. 1991"),
    "PCMLTFA": ("PCMLTFA", "Proceeds of Crime", "Money Laundering", "S.C. 2000"),
    "PIPEDA": ("PIPEDA", "Personal Information Protection", "S.C. 2000"),
}
FEDERAL_WORDS = ("S.C.", "Parliament of Canada", "Governor in Council")
PROVINCIAL_WORDS = ("Ontario", "Quebec", "British Columbia", "Alberta")
DOCUMENT_TYPES = {"act": "Act", "regulation": "Regulation", "guidance": "Guideline", "policy": "Policy"}
CATEGORY_ORDER = {"act": 1, "regulation": 2, "guidance": 3, "policy": 4}
FILENAME_TYPES = (
    (("act",), "Act"),
    (("reg",), "Regulation"),
    (("guideline", "guidance"), "Guideline"),
    (("policy", "policies"), "Policy"),
    (("standard",), "Standard"),
)
FILENAME_JURISDICTIONS = (
    (("canada", "canadian", "osfi", "pcmltfa"), "Canada"),
    (("us", "sec", "glba", "nydfs"), "United States"),
    (("uk", "fca"), "United Kingdom"),
    (("eu", "gdpr", "eba"), "European Union"),
)
ACT_SLUGS = {
    "Bank Act": "B-1.01",
    "PCMLTFA": "P-24.501",
    "Proceeds of Crime (Money Laundering) and Terrorist Financing Act": "P-24.501",
    "PIPEDA": "P-8.6",
    "Personal Information Protection and Electronic Documents Act": "P-8.6",
    "Canada Labour Code": "L-2",
    "Access to Information Act": "A-1",
    "Privacy Act": "P-21",
}
KNOWN_PARENT_ACTS = {"SOR-2021-181": "Bank Act (S.C.1991, c. 46)"}
RISK_TO_SEVERITY = {
    "critical": "punitive", "high": "punitive", "medium": "mandatory", "low": "definitional",
}

# Bilingual detection.
FRENCH_INDICATORS = (
    "la", "le", "les", "des", "une", "est", "sont", "aux", "dans", "sur", "par", "pour", "cette",
    "avec", "qui", "que", "du", "en", "ou", "Loi", "loi", "article", "alinéa", "paragraphe",
    "règlement", "partie", "chapitre", "dispositions", "renseignements", "personnels",
    "protection", "commissaire",
)
BILINGUAL_MARKERS = (
    r"À jour au", r"Dernière modification le", r"Codification", r"L\.C\.\s+\d{4}", r"ch\.\s+\d+",
    r"Publié par le ministre", r"PARTIE\s+\d+", r"ANNEXE\s+\d+",
)
FRENCH_TITLE_WORDS = ("FRANÇAIS", "FRENCH", "TABLE ANALYTIQUE")
FRENCH_RESIDUE = ("loi", "règlement", "déclaration", "financier")

# Stop words per language for block-level language scoring.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "by", "are", "be", "this",
           "from", "which", "or", "was", "it", "an", "shall", "must", "may", "not", "any"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "un", "du", "dans", "que", "qui", "pour",
           "par", "sur", "avec", "au", "aux", "ou", "sont", "pas", "cette", "ce", "en"),
    "de": ("der", "die", "das", "und", "ist", "von", "mit", "den", "dem", "ein", "eine", "nicht",
           "zu", "auf", "für", "als", "auch", "sich", "des", "im", "es", "wird", "oder", "sind"),
    "es": ("el", "los", "las", "de", "y", "que", "en", "una", "un", "es", "por", "con", "para",
           "del", "se", "no", "su", "al", "como", "más", "o", "este", "sus", "lo"),
}

# Cross references: pattern order matters for de-duplication.
REFERENCE_PATTERNS = (
    r"(?U)(?i)(?:section|subsection|paragraph|clause|subclause)\s+(\d+[\(\)\.0-9a-z]*)",
    r"(?U)(?i)under\s+(?:the\s+)?(PIPEDA|Privacy Act|Personal Information Protection)",
    r"(?U)(?i)(?:Schedule|Part)\s+(\d+|[IVXLCDM]+)",
)

# Graph.
NODE_TYPES = {
    "obligation": "obligation", "prohibition": "prohibition", "permission": "permission",
    "definition": "definition", "procedural": "section",
}
ONTOLOGY = {
    "contains": (("regulation", "section"), ("section", "clause")),
    "defines": (("section",), ("definition",)),
    "cites": (("section",), ("section", "regulation")),
    "requires_alignment": (("section",), ("section",)),
    "conflicts_with": (("section", "policy"), ("section", "policy")),
    "policy_implements_regulation": (
        ("policy", "policy_clause", "control"),
        ("regulation", "section", "obligation", "prohibition"),
    ),
    "mitigates": (("control",), ("policy_implements_regulation",)),
}
DOMAIN_KEYWORDS = {
    "AML": ("laundering", "terrorist financing", "kyc", "fintrac"),
    "PRIVACY": ("personal information", "consent", "breach", "pipeda"),
    "CYBER": ("encryption", "incident response", "access control"),
    "CONSUMER": ("disclosure", "complaint", "fee", "fcac"),
}

# Retrieval modes: semantic top-k and weight, lexical top-k and weight, final
# top-k, score threshold.
RETRIEVAL_MODES = {
    "precision": (15, 0.7, 10, 0.3, 3, 0.85),
    "recall": (50, 0.5, 50, 0.5, 20, 0.5),
    "balanced": (20, 0.6, 15, 0.4, 10, 0.7),
    "fast": (10, 1.0, 0, 0.0, 10, 0.65),
    "exact": (10, 0.2, 30, 0.8, 10, 0.6),
    "semantic_only": (20, 1.0, 0, 0.0, 10, 0.75),
    "citation": (20, 0.3, 50, 0.7, 15, 0.6),
}
CITATION_PATTERNS = (r"\b\d+\s+USC\s+\d+", r"\bSection\s+\d+", r"\b[A-Z]+\s+\d+-\d+")
NEAR_DUPLICATE_AT = 0.98
OUTLIER_BELOW = 0.30
BATCH_FAILURE_LIMIT = 0.10
COMPLETENESS = {"required": 1.00, "optional": 0.80}
