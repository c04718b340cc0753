"""Word lists, patterns and thresholds that decide results.

They are data, not logic, and are kept together so that a change of a rule is a change here.
"""

# --- transcripts -----------------------------------------------------------------------
ID_COLUMNS = ["transcript_id", "Transcript_ID", "id", "ID"]
CONVERSATION_COLUMNS = ["conversation", "Conversation", "transcript", "Transcript", "text", "Text"]
DEFAULT_DOMAIN = "General"
SPEAKER_LABELS = ["Agent", "Customer", "Representative", "User", "Caller", "Support"]
USER_ALIASES = ["user", "customer", "client"]
TEXT_KEYS = ["text", "utterance", "transcript", "Content", "content", "utterances", "utterance_text"]
SPEAKER_KEYS = ["speaker", "ParticipantRole", "participant_role", "role", "speaker_label"]
DIALOGUE_KEYS = ["conversation", "transcript_id", "turns", "transcript"]
DIALOGUE_TURN_KEYS = ["conversation", "turns", "transcript"]

# Field values that a CSV reader of the pandas family takes for "missing".
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- clusters --------------------------------------------------------------------------
N_CLUSTERS = 8
N_EXEMPLARS = 5
N_KEY_PHRASES = 5
TONE_SAMPLE = 20
TONE_MARGIN = 0.1
ACTION_ONTOLOGY = {
    "inform": "provide information explain clarify",
    "request": "ask inquire need require assistance",
    "apologize": "sorry apologize regret inconvenience",
    "resolve": "fixed solved working now",
    "redirect": "transfer escalate manager",
}

# --- seed queries ----------------------------------------------------------------------
SEED_TEMPLATES = [
    ("pattern_discovery", "Why do customers frequently {action} when discussing {theme}?"),
    ("outcome_analysis", "How does {action} impact the resolution of {theme} issues?"),
    ("speaker_dynamics",
     "What is the typical agent response when a customer {action} regarding {theme}?"),
    ("comparative",
     "Compare the outcomes of {action} versus other actions in {theme} contexts."),
]
MAX_SEEDS = 10
QUERIES_PER_SEED = 3
MAX_QUERIES = 50
MIN_WORDS_EXCLUSIVE = 10
MAX_WORDS_EXCLUSIVE = 30

# --- query rules -----------------------------------------------------------------------
MAX_QUERY_WORDS = 50
CAUSAL_VERBS = ["cause", "lead", "influence", "result", "impact", "trigger", "motivate"]
TRIVIAL_PHRASES = [
    "what date", "what time", "what hotel", "what room", "which agent",
    "booking id", "phone number", "confirmation number",
]
FACTUAL_PATTERNS = [
    r"\bwhat (did|was|is)\b.*\b(mention|say|tell)\b",
    r"\bwho (said|mentioned)\b",
]
GENERIC_TRIGGERS = ["the agent", "agent action", "customer"]
GENERIC_OUTCOMES = ["outcome", "result", "customer reaction"]
DECISIONS = ["ACCEPT", "REJECT"]
QUALITIES = ["strong", "moderate", "weak"]

# --- events ----------------------------------------------------------------------------
EVENT_BUCKETS = [
    ("escalation", ["escala", "supervisor", "manager", "complaint", "angry", "frustrat"]),
    ("churn", ["cancel", "switch", "competitor", "retention", "promotion", "pricing",
               "loyalty", "winback", "renewal", "downgrade"]),
    ("refund", ["refund", "chargeback", "billing", "payment", "invoice", "return"]),
    ("compliance", ["compliance", "privacy", "legal", "gdpr", "hipaa", "policy", "kyc",
                    "verification", "consent"]),
]
GENERAL_EVENT = "general"

# --- evidence --------------------------------------------------------------------------
EVIDENCE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "is", "was", "were", "are",
    "did", "does", "do", "why", "how", "what", "when", "where",
    "who", "which", "this", "that", "these", "those", "of", "to",
    "in", "for", "on", "with", "from", "by", "at", "about",
]
MATCH_THRESHOLD = 85
STRONG_FROM = 95
MODERATE_FROM = 80

# --- judging ---------------------------------------------------------------------------
ACCEPT_ABOVE = 3.5
EXCERPT_CHARS = 500
OFFLINE_SCORES = (4, 4, 3)
OFFLINE_REASON = "Offline validation: heuristic acceptance in LLM-disabled mode"
FAILED_SCORES = (1, 1, 1)
FAILED_REASON = "Validation error: LLM judge failed"

# --- topics ----------------------------------------------------------------------------
QUERY_TOPIC_STOP_WORDS = [
    "what", "when", "where", "which", "why", "how",
    "does", "have", "been", "really", "would", "could",
    "should", "must", "likely", "often",
]
RESPONSE_TOPIC_STOP_WORDS = [
    "from", "have", "been", "when", "where", "which",
    "reason", "caused", "because", "result", "outcome",
    "percent", "percentage", "time", "days", "hours",
    "includes", "involves", "related", "based",
]
QUERY_WEIGHT = 0.6
RESPONSE_WEIGHT = 0.4
ACTION_BUMP = 2
TOPIC_WORDS_PER_TEXT = 5
N_TOPICS = 8
N_PHRASES = 5
PHRASE_RESPONSE_CHARS = 200

# --- follow-ups ------------------------------------------------------------------------
CATEGORIES = ["causal", "impact", "pattern"]
OTHER_CATEGORY = "other"
MIN_FOLLOWUP_CHARS = 10
MAX_FOLLOWUP_WORDS = 75
MAX_FOLLOWUPS = 3

# --- completion prices, USD per million tokens (input, output) ---------------------------
PRICES = {
    "gpt-4o": (5.0, 15.0),
    "gpt-4o-mini": (0.15, 0.6),
    "claude-3-5-sonnet-20241022": (3.0, 15.0),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "gemini/gemini-1.5-flash": (0.075, 0.3),
    "groq/llama-3.3-70b-versatile": (0.59, 0.79),
}
