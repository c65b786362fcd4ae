"""Constants the study fixes.

Fixed values: results depend on each of them being exactly this.
"""

# Evidence-distance bins, half open [lo, hi).
BINS = (
    ("B1", 128, 256),
    ("B2", 256, 512),
    ("B3", 512, 1024),
    ("B4", 1024, 2048),
    ("B5", 2048, 3072),
    ("B6", 3072, 4096),
)
BIN_IDS = tuple(name for name, _, _ in BINS)

# The seven scalars of one (token, layer, head), in storage order.
FEATURES = (
    "stable_rank_qkt",
    "grassmannian_qkt",
    "spectral_entropy_qkt",
    "stable_rank_avwo",
    "grassmannian_avwo",
    "spectral_entropy_avwo",
    "forman_ricci_attention_graph",
)
RICCI_FEATURE = "forman_ricci_attention_graph"

# Two head graphs per (token, layer).
EDGE_TYPES = ("qkt_grassmannian", "avwo_grassmannian")

# Lookback positions relative to the token at which the answer starts.
DENSE_LOOKBACK = 256
SPARSE_LOOKBACK = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256)

# Answer normalization.
LEADING_ARTICLES = ("the ", "an ", "a ")
STOP_STRINGS = ("\n", "<|end|>")

# Prompt text; its SHA-256 is part of every event id.
PROMPT_TEMPLATE = """<|system|>You are answering questions about the document below. Answer with only the answer, no preamble.<|end|>
<|user|>{document}

Question: {question}
Answer:<|end|>
<|assistant|>"""

# Coarsenings.
DENSITY_CUTS = (("low", 0.25), ("med", 0.75))
DENSITY_TOP = "high"
LENGTH_CUTS = (("1", 1), ("2-3", 3))
LENGTH_TOP = "4+"

# Seed namespaces.
SEED_NAMESPACES = ("event", "match", "split", "analysis")

# Tiered matching: pool size per tier and yield limits in percent.
TIER_FACTORS = (1.5, 3.0)
YIELD_OK = 50.0
YIELD_COMPROMISED = 30.0
YIELD_REVIEW = 10.0

# Distractor policies.
POLICIES = ("none", "lexical", "sibling_entity", "self_contradiction")
MIN_SHARED_TOKENS = 2
N_ADVERSARIAL = 3

# Model fits.
MIN_ROWS_PER_FIT = 100
MARGINAL_GAIN = 0.02
MIN_BINS = 4
AUROC_TARGET = 0.80
AUROC_CI_TARGET = 0.50
POOLED_AUROC_LIMIT = 0.75
POOLED_CI_LIMIT = 0.55
AGREEMENT_TARGET = 99.0
SWEEP_K = (8, 16, 32)

# Event columns kept in the text table rather than in the index table.
TEXT_COLUMNS = ("document", "question", "gold_answer", "model_generation")

# Columns of the one-row study header.
HEADER_COLUMNS = (
    ("schema_version", "string"),
    ("manifest_sha256", "string"),
    ("events_sha256", "string"),
    ("code_commit_sha", "string"),
    ("model_revision_sha", "string"),
    ("prompt_template_sha256", "string"),
    ("generation_config_sha256", "string"),
    ("k_grass", "int"),
    ("k_attn", "int"),
    ("lookback_window_length", "int"),
    ("feature_layout", "array<string>"),
    ("forman_ricci_convention", "string"),
    ("adversariality_policy_per_bin", "map<string,string>"),
    ("split_seed", "bigint"),
    ("matching_seed_per_bin", "map<string,bigint>"),
    ("constitution_version", "string"),
    ("spec_version", "string"),
    ("write_timestamp_utc", "string"),
)

# Event columns, in schema order.
EVENT_COLUMNS = (
    ("event_id", "string"),
    ("document", "string"),
    ("question", "string"),
    ("gold_answer", "string"),
    ("question_template_id", "string"),
    ("evidence_position_token_idx", "int"),
    ("evidence_distance_tokens", "int"),
    ("bin_id", "string"),
    ("distractor_density", "double"),
    ("distractor_density_coarsening", "string"),
    ("gold_answer_length_tokens", "int"),
    ("gold_answer_length_coarsening", "string"),
    ("cem_stratum_id", "string"),
    ("adversariality_policy", "string"),
    ("model_generation", "string"),
    ("model_generation_normalized", "string"),
    ("gold_answer_normalized", "string"),
    ("is_fail", "boolean"),
    ("per_event_seed", "bigint"),
)
