"""Fixed values.

Everything in this module is a constant that results depend on: word lists, thresholds, labels and
limits.  They are stated here once, in natural order, and are default arguments elsewhere.
"""

# --- fixed values: time-band alignment (milliseconds) ---
ALIGNMENT_WINDOW_MS = 6_000
HIGH_CONFIDENCE_MS = 1_000
MEDIUM_CONFIDENCE_MS = 3_000
CLOCK_SKEW_WARNING_MS = 6_000
START_DELTA_LIMIT_MS = 5_000
NEARBY_LIMIT = 4

# --- fixed values: receipt freshness ---
MAX_RECEIPT_AGE_MS = 24 * 60 * 60 * 1_000
MAX_FUTURE_SKEW_MS = 5 * 60 * 1_000

# --- fixed values: size limits per session ---
EVENT_MAX_BYTES = 32 * 1024 * 1024
EVENT_MAX_ROWS = 20_000
EVENT_TEXT_MAX_BYTES = 4 * 1024
TRANSCRIPT_MAX_BYTES = 8 * 1024 * 1024
TRANSCRIPT_MAX_ROWS = 20_000
TRANSCRIPT_TEXT_MAX_BYTES = 64 * 1024
MAX_ALIGNMENT_SEGMENTS = 10_000
MAX_ALIGNMENT_WORK_ITEMS = 5_000_000
MAX_ALIGNMENT_TOKENS_PER_SIDE = 10_000
MAX_ALIGNMENT_CELLS = 4_000_000
MAX_ALIGNMENT_TEXT_BYTES_PER_SIDE = 4 * 1024 * 1024
MAX_ALIGNMENT_TOKEN_BYTES = 256
MAX_CLEANUP_TOKENS = 100_000
SCAN_MAX_BYTES_PER_FILE = 8 * 1024 * 1024
SCAN_MAX_BYTES_PER_SESSION = 32 * 1024 * 1024
ARTIFACT_MAX_BYTES = 64 * 1024 * 1024
JSONL_MAX_ROWS = 100_000
JSONL_MAX_ROW_BYTES = 1024 * 1024
UI_HINT_MAX_CHARS = 240
UNTRUSTED_TEXT_MAX_CHARS = 4_096
STREAM_MAX_MESSAGE_BYTES = 256 * 1024
STREAM_MAX_BYTES = 32 * 1024 * 1024
STREAM_MAX_EVENTS = 50_000
MINIMUM_COMMIT_BYTES = 4_800
COMMIT_INTERVAL_MS = 5_000
DRAIN_TIMEOUT_MS = 5_000
BYTES_PER_SAMPLE = 2
SAMPLE_RATE = 24_000

# --- fixed values: word lists ---
ACTION_WORDS = (
    "click", "clicked", "type", "typed", "select", "selected", "open", "opened", "save", "saved",
    "submit", "submitted", "press", "pressed", "drag", "dragged", "drop", "dropped",
)
COMMIT_WORDS = ("save", "saved", "submit", "submitted", "confirm", "confirmed")
CANCEL_WORDS = ("cancel", "delete", "discard", "close", "back", "remove", "reject")
MARKER_LABELS = (
    "alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet",
    "kilo", "lima", "mike", "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango",
    "uniform", "victor", "whiskey", "xray", "yankee", "zulu",
)
SCRIPTED_LABELS = MARKER_LABELS[:17]
CANONICAL_PAIRS = (
    ("cloud", "claude"), ("claude", "cloud"),
    ("chatgpt", "chat"), ("chat", "chatgpt"),
    ("atlas", "atlases"), ("atlases", "atlas"),
    ("tinga", "tinka"),
    ("kilo", "keyhole"), ("keyhole", "kilo"),
    ("mike", "mic"), ("mic", "mike"),
    ("papa", "pop"), ("pop", "papa"),
    ("vesper", "fesper"), ("fesper", "vesper"),
)
# Vocabulary a cleaned transcript may correct towards; callers add their own product names.
CLEANUP_VOCABULARY = (
    "OpenAI", "ChatGPT", "Codex", "Claude", "Claude Code", "Playwright", "WebSocket", "macOS",
    "AppleScript", "SQLite",
)
PASSWORD_KEYS = ("password", "passwd", "passphrase", "pwd")
SENSITIVE_KEYS = PASSWORD_KEYS + (
    "token", "secret", "api_key", "apikey", "openai_api_key", "authorization", "bearer",
    "access_token", "auth_token", "refresh_token", "client_secret", "private_key", "credential",
    "signature", "sig", "x_amz_signature", "x_goog_signature", "awsaccesskeyid",
)
PRIVATE_PATH_PREFIXES = (
    "/Users/", "/home/", "~/", "/private/var/", "/var/folders/", "/private/tmp/",
)

# --- fixed values: allowed values ---
VOICE_STYLES = ("neutral", "calm", "focused", "energetic")
VOICE_PACES = ("slow", "normal", "fast")
VOICE_EMPHASES = ("low", "balanced", "high")
CLAIM_KINDS = (
    "feature_completion", "integration", "process_compliance", "security", "static_contract",
    "ui_surface",
)
CLAIM_SURFACES = (
    "static", "runtime_cli", "runtime_api", "ui_computer", "observability", "ui_browser",
    "product_cohesion",
)
CLAIM_EFFECTS = ("satisfied", "degraded", "blocked", "withheld")
PROVEN_STATUS = "proven_static"
OPEN_STATUSES = (
    "contract_only", "simulated_only", "lane_owed", "root_owed", "externally_blocked",
    "withheld_claim", "unsupported",
)
EVIDENCE_KINDS = ("static_check", "runtime_execution")
CHANGE_CLASSES = ("strengthens", "clarifies", "evidence_refresh")

# --- fixed values: labels that appear in results ---
MONOTONIC_SOURCE = "process-local-monotonic-offset"
WALL_CLOCK_SOURCE = "audio-wall-clock-offset"
ALIGNED_SOURCE = "aligned-cleaned-batch-text-with-realtime-window"
SPARSE = "too-sparse-for-non-toy-replay"
NEEDS_DISTILLATION = "needs-operator-distillation"
SUFFICIENT = "sufficient-for-operator-review"
EMPTY_DIGEST = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# --- fixed values: names and dispositions of artifacts ---
REQUIRED_DIGESTS = (
    "recording-metadata", "recording-events", "manifest", "capture-status", "capture-clock",
    "post-commit-drain", "parent-operation-receipt", "temporal-context",
    "evidence-boundary-report", "packet-inspection", "final-transcript-alignment",
)
OVER_BUDGET = "artifact-inspection-budget-exceeded"
UNRESOLVED = "unresolved-sensitive-content"
EXPECTED_PATH = "expected-local-artifact-reference"
EXPECTED_OPAQUE = "expected-local-opaque-token-reference"

# --- fixed values: messages ---
PACKET_REVIEW_OWED = "real non-toy packet usefulness review still owed"
STANDING_NOTES = (
    "real non-toy workflow packet usefulness inspection is still owed",
    "raw-private leakage inspection is still owed before sharing",
)
ATTESTATION_MISSING = "trusted external current-run execution attestation is unavailable"
OPERATOR_REVIEW = "operator review of generated artifacts is still required"
COHESION_OWED = (
    "real non-toy packet product-cohesion review still owed",
    "replay voice execution receipt still owed",
)
SECTIONS = {
    "has_goal": "Goal: ",
    "has_capture_artifacts": "## Capture Artifacts",
    "has_evidence_boundary": "## Evidence Boundary",
    "has_refinement_instructions": "## Refinement Instructions",
    "has_alignment_summary": "## Temporal Alignment Summary",
    "has_review_boundary": "## Transcript Review Boundary",
}
DENSITY_WARNINGS = {
    SPARSE: "Narration is too sparse for confident non-toy replay refinement.",
    NEEDS_DISTILLATION: "Narration needs operator distillation before durable skill edits.",
    SUFFICIENT: "No narration-density warning from automated checks.",
}
MESSAGES = {
    "packet-missing": "skill-refinement-packet.md is missing",
    "notes-missing": "timestamped-notes.md is missing",
    "thought-missing": "thought-process.md is missing",
    "temporal-missing": "temporal-context.json is missing",
    "evidence-missing": "evidence-boundary-report.json is missing",
    "contract-missing": "review-contract.json is missing",
    "packet-no-segments": "packet has no transcript segments",
    "packet-sparse": "narration is too sparse for confident non-toy replay refinement",
    "packet-no-aligned": "packet has no aligned segments",
    "conflicts-need-review": "conflict warnings need operator review",
    "metadata-unusable": "provided recording metadata artifact is missing or empty",
    "events-unusable": "provided recording events artifact is missing or empty",
    "conflicts-require-review": "conflict warnings require operator review",
    "candidates-leak": "generated review candidates contain obvious unredacted sensitive patterns",
    "not-stopped": "narration helper did not stop cleanly",
    "not-coordinated": "recording and microphone capture were not started by one coordinated operation",
    "parent-unverified": "parent operation receipt is missing or mismatches artifacts",
    "run-id-missing": "trusted current-run receipt id is missing",
    "proof-invalid": "current-run proof schemas or producer statuses are invalid",
    "clock-missing": "audio clock anchor is missing or unproven",
    "no-segments": "no transcript segments are present",
    "drain-missing": "post-commit transcription drain receipt is missing",
    "drain-empty": "post-commit transcription drain did not complete any segments",
    "drain-errors": "post-commit transcription drain recorded errors",
    "no-events": "no recording events are present",
    "not-aligned": "final transcript alignment is missing or has unresolved mismatches",
    "mismatches": "final transcript alignment has unresolved mismatches",
    "not-inspected": "packet inspection has not been run",
    "leak-blocked": "generated artifact leak scan is blocked",
    "privacy-open": "privacy boundary has not been inspected",
    "digest-unbound": "current-run proof digest binding is missing or changed during verification",
    "context-missing": "temporal context missing",
    "card-packet-missing": "skill refinement packet missing",
    "card-evidence-missing": "evidence boundary report missing",
    "plan-missing": "replay voice dry-run execution plan missing",
    "plan-malformed": "replay voice dry-run execution plan is malformed or incomplete",
    "plan-speaks": "replay voice execution plan is not marked as no-audio dry-run",
    "inspection-missing": "packet inspection missing",
    "receipt-missing": "receipt missing for live proof review",
    "leaks-need-review": "generated artifact leak findings need privacy review",
    "raw-needs-review": "raw-local transcript artifacts contain sensitive categories requiring privacy review",
    "density-sparse": "narration density is too sparse for confident packet reuse",
    "quality-incomplete": "transcript quality pipeline is incomplete or disabled",
    "proofs-malformed": "review proofs are malformed, stale, self-authored, or unbound",
    "metadata-path-missing": "recording metadata path is required for live capture proof",
    "metadata-path-empty": "recording metadata path must exist as a non-empty file",
    "events-path-missing": "recording events path is required for live capture proof",
    "events-path-empty": "recording events path must exist as a non-empty file",
}

# Labels and reasons of alignment, cleanup check and latency comparison.
NO_SOURCE = "no-token-alignment-for-cleaned-utterance"
LOW_SIMILARITY = "low-cleaned-utterance-token-similarity"
MARKER_UNSEEN = "optional-marker-anchor-not-found-low-confidence-window"
LOW_FALLBACK = "low-token-similarity"
TRAILING = "cleaned-trailing-words-without-realtime-window"
VERIFIED = "verified-conservative-transform"
UNTRUSTED = "untrusted-model-output"
PRESERVED = "token order and semantic content preserved"
EMPTY = "empty transcript or cleanup output"
TOO_LONG = "cleanup validation token bound exceeded"
CHANGED = "cleanup output added, removed, reordered, or materially changed words"
INCOMPLETE = "required comparison metrics are missing"
IMPROVED = (
    "candidate latency improved without worse machine alignment metrics; "
    "transcript/action usefulness review is still required"
)
NOT_IMPROVED = "candidate did not improve latency while preserving machine alignment metrics"
