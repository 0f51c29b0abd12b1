"""Settings for image analysis and image search.

Defaults are the published setting defaults of the forum plugin this engine
re-implements; callers override them per job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column

# Fixed values that must equal the reference for identical results.
SUPPORTED_IMAGE_TYPES = ("jpg", "jpeg", "png", "webp")
PAGE_SIZE = 20
ANN_DEFAULT_SEARCH_WIDTH = 40
QUERY_EMBEDDING_TTL_SECONDS = 5 * 60
BACKFILL_BATCH = 100
BACKFILL_MAX_FAILURES = 50
FLAG_TYPE = "inappropriate"
FLAG_REASON = "watched_word"
FLAG_ACTOR = "system"


@dataclass(frozen=True)
class Settings:
    enabled: bool = False
    search_enabled: bool = False
    min_image_width: int = 100
    min_image_height: int = 100
    max_image_size_kb: int = 4096
    analyze_image_base64_encoded: bool = False
    max_images_per_post: int = 5
    ignored_tags: tuple[str, ...] = ()
    ignored_categories: tuple[str, ...] = ()
    tagging_enabled: bool = True
    auto_flag_ocr: bool = False
    max_retry_times_per_image: int = 3
    analyze_ocr_enabled: bool = False
    analyze_embedding_enabled: bool = False
    text_similarity_threshold: float = 0.4
    image_similarity_threshold: float = 0.8
    base_url: str = ""
    embedding_dim: int = 512
    # Index and query lexemes: Han runs as bigrams, and a hook for stop words or stemming
    # (a function from the lexeme array column to the array to keep).
    cjk_bigrams: bool = False
    lexeme_filter: Callable[[Column], Column] | None = None

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)

    @staticmethod
    def from_pipe_lists(ignored_categories: str = "", ignored_tags: str = "", **kw) -> "Settings":
        """Build settings from the pipe-delimited list form of the host."""
        cats = tuple(x for x in ignored_categories.split("|")) if ignored_categories else ()
        tags = tuple(x for x in ignored_tags.split("|")) if ignored_tags else ()
        return Settings(ignored_categories=cats, ignored_tags=tags, **kw)

    @property
    def ignored_category_ids(self) -> list[int]:
        """Non-numeric entries become 0, like a Ruby ``to_i``."""
        out = []
        for x in self.ignored_categories:
            digits = ""
            for ch in str(x).strip():
                if ch.isdigit() or (not digits and ch in "+-"):
                    digits += ch
                else:
                    break
            try:
                out.append(int(digits))
            except ValueError:
                out.append(0)
        return out


# Settings used by the derived test forum (see FIXTURES.md).
TEST_SETTINGS = Settings(
    enabled=True,
    search_enabled=True,
    ignored_categories=("3", "8"),
    ignored_tags=("machinery",),
    analyze_ocr_enabled=True,
    analyze_embedding_enabled=True,
    auto_flag_ocr=True,
    embedding_dim=64,
)
