"""Constants of the engine. Tools differ in what they skip, so each set keeps its own name."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace

#: Words that the tokenizer drops.
STOPWORDS = tuple(
    """
a an and are as at be by for from has have he her him his i if in is it its
of on or that the their them they this to was were will with you your
il la le gli un una uno di da del della dello dei degli delle al alla alle
agli dal dalla dai dalle nel nella nei nelle sul sulla sui sulle con per tra
fra che chi cui non si se sono essere ed ma anche come dove quando cosa quale
quali questo questa questi queste quello quella mio mia suo sua loro più già
""".split()
)
#: Statuses, types and file names that the tools go by.
STALE_STATUSES = ("archived", "superseded", "deprecated", "closed", "decommissioned", "erased")
LIVE_STATUSES = ("", "active", "evergreen", "stable", "current", "live")
CATALOG_SKIP = ("index.md", "_index.md", "hot.md", "log.md")
INGEST_SKIP = ("wiki/log.md", "wiki/hot.md")
PAGE_TYPES = ("user", "feedback", "entity", "source", "meta")
REQUIRED_KEYS = ("name", "description", "type")
ORPHAN_SKIP = ("index.md", "log.md", "hot.md", "overview.md", "_index.md", "WIKI.md")
BRIEF_SKIP = ("stale", "hot_oversize", "log_oversize")
TILING_SKIP_TYPES = ("meta", "fold")
TILING_SKIP_NAMES = ("_index.md", "index.md", "log.md", "hot.md", "overview.md", "dashboard.md", "Wiki Map.md", "getting-started.md")
TILING_SKIP_PREFIXES = ("wiki/folds/", "wiki/meta/", "wiki/.lint/")
CONSOLIDATION_SCOPE = ("wiki/entities", "wiki/sources", "wiki/runbooks")
#: Typed-graph vocabulary.
INVERSE_PAIRS = (
    ("hosted_on", "hosts"), ("monitored_by", "monitors"), ("documented_in", "documents"),
    ("replaces", "replaced_by"), ("blocks", "blocked_by"), ("consumed_by", "consumes"),
    ("managed_by", "manages"), ("references", "referenced_by"), ("implements", "implemented_by"),
)
INVERSE_FREE = ("depends_on", "part_of", "related_to")
GRAPH_TYPES = ("entity", "source")
IDEA_KINDS = ("automation", "simplification", "synergy", "experiment", "question")
IDEA_FIELDS = ("title", "idea", "first_step", "quote_a", "quote_b")
PAIR_RELATIONS = ("contradiction", "stale", "duplicate")
#: Patterns. Written so that Java and RE2 read them alike.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]*"
WORD4 = r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]{3,}"
STRUCK = r"(?s)~~(?=\S)(?:(?!~~|\n\n).)+?~~"
FENCED = r"(?sm)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$"
INLINE_CODE = r"(`+)[^\n]*?(?<!`)\1(?!`)"
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
PREFIX_LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
DATED_HEADING = r"(?dm)^#{2,3} [^\n]*?\b(20\d\d-\d\d-\d\d)"
TRIVIAL = r"(?i)^\s*(ok(ay)?|s[iì]|yes|no|va bene|vai|procedi|continua|retry|riprova|fai tu|concludi|perfetto|grazie|thanks|go|fatto|chiudiamo)\b[\s.!,]*$"
HARNESS = r"<(command-name|local-command-[a-z]+|system-reminder|task-notification)>"
ELISION = r"(?iU)\b(l|un|dell|all|nell|dall|sull|quell|quest|c|d|s|m|t|v|n|po|qual|com|dov|anch)-(?=\w)"
LOG_ENTRY = r"^- (20\d\d-\d\d-\d\d) · (?:([^·*]+?) · )?\*\*([^*]+)\*\*(?: — (.*))?$"
#: What stands before queries and documents of each family of embedding models.
MODEL_PREFIXES = {
    "nomic-embed-text": ("search_query: ", "search_document: "),
    "qwen3-embedding": ("Instruct: Given a search query, retrieve relevant passages that answer the query\nQuery: ", ""),
}
#: Skip patterns of the scans.
SCAN_SKIP = r"^wiki/(folds/|log\.md|hot\.md|index\.md|.*_index\.md|meta/(lint-report|tiling-report|20\d\d-))"
SEED_SKIP = r"^wiki/(meta/profile/|overview\.md)"


@dataclass(frozen=True)
class Settings:
    """Every tunable of the engine. The defaults."""

    k1: float = 1.5
    b: float = 0.75
    bm25_top: int = 20
    top: int = 5
    per_page_cap: int = 2
    fold_weight: float = 0.95
    ce_top: int = 6
    chunk_target: int = 2000
    chunk_overlap: int = 200
    text_cap: int = 6000
    snippet: int = 200
    recall_threshold: float = 0.44
    recall_pointers: int = 2
    query_cap: int = 600
    excerpt_cap: int = 220
    scan_floor: float = 0.70
    band_error: float = 0.90
    band_review: float = 0.80
    scan_pairs: int = 30
    seed_pairs: int = 12
    stale_days: int = 90
    hot_bytes: int = 7168
    log_lines: int = 500
    tiling_chars: int = 5500
    tiling_bytes: int = 128 * 1024
    tiling_warn: int = 500
    tiling_fail: int = 5000
    journal_kb: float = 15.0
    journal_dated: int = 5
    journal_struck: int = 10
    regrow_ratio: float = 1.5
    regrow_kb: float = 5.0
    regrow_dated: int = 3
    quote_chars: int = 15
    log_keep: int = 500
    log_bytes: int = 256 * 1024


DEFAULTS = Settings()


def load_settings(path: str | None, base: Settings = DEFAULTS) -> Settings:
    """``base`` with the values of a JSON object; where there is no such file, ``base``. An unknown name is an error."""
    if path is None or not os.path.exists(path):
        return base
    with open(path, encoding="utf-8") as f:
        return replace(base, **json.load(f))


def described(settings: Settings = DEFAULTS) -> dict[str, object]:
    """Every setting by name."""
    return asdict(settings)
