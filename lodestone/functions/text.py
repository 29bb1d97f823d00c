"""Scalar functions of the engine as Column expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PROMPT = "Describe where the passage stands in its document, then list its keywords. Answer in two lines, CONTEXT: and KEYWORDS:."
WHOLE_CONTEXT, LARGE_CONTEXT, CONTEXT_PART = 4000, 20000, 2000
EMBEDDING_INPUT = 12000
GUID = r"^[{(]?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[)}]?$"
FULL_DIMENSION = 3072
DEFAULT_BATCH = 256
# Provider:model -> embedding batch size.
BATCH_SIZES = {"openai:text-embedding-3-small": 512, "openai:text-embedding-3-large": 512, "openai:text-embedding-ada-002": 512, "ollama:qwen3-embedding:8b": 64, "ollama:qwen3-embedding:0.6b": 256, "ollama:nomic-embed-text": 256, "ollama:mxbai-embed-large": 128, "gemini:gemini-embedding-2": 100}


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256 over UTF-8."""
    return F.substring(F.sha2(c, 256), 1, 16)


def path_hash(path: Column) -> Column:
    """The first 16 bits of the digest that ids of a file's chunks begin with."""
    return F.conv(F.substring(F.sha2(F.coalesce(path, F.lit("")), 256), 1, 4), 16, 10).cast("int")


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(short_hash(path), F.lit("_"), index.cast("string"))


def storage_path(relative: Column, source_index: Column | None = None) -> Column:
    path = F.translate(relative, "\\", "/")
    return path if source_index is None else F.concat(source_index.cast("string"), F.lit("/"), path)


def context_of(text: Column) -> Column:
    """Document context for a prompt: whole, head and tail, or head only; null for an empty text."""
    return context_from(F.length(text), text, text)


def context_from(n: Column, head: Column, tail: Column) -> Column:
    """The same of a text of n characters, of which head has the first WHOLE_CONTEXT and tail the last CONTEXT_PART
    at least; tail is looked at for texts of middle length only."""
    first = F.substring(head, 1, CONTEXT_PART)
    middle = F.concat(first, F.lit("\n...\n"), F.right(tail, F.lit(CONTEXT_PART)))
    return F.when(n == 0, F.lit(None)).when(n <= WHOLE_CONTEXT, head).when(n <= LARGE_CONTEXT, middle).otherwise(F.concat(first, F.lit("\n...(truncated)")))


def prompt_of(chunk: Column, context: Column, name: Column, index: Column, total: Column) -> Column:
    summary = F.when(F.coalesce(F.length(context), F.lit(0)) > 0, F.concat(F.lit("\n<document_summary>\n"), context, F.lit("\n</document_summary>\n"))).otherwise("")
    head = F.format_string("Source: %s (chunk %d of %d)\n", name, index + 1, total)
    return F.concat(head, summary, F.lit("\n<chunk>\n"), chunk, F.lit("\n</chunk>\n"))


def enriched_of(answer: Column, chunk: Column) -> Column:
    """The chunk below the last CONTEXT and KEYWORDS lines of a model's answer, or alone without them."""

    def last(label: str) -> Column:
        own = F.filter(F.split(answer, "\n"), lambda x: F.upper(F.substring(x, 1, len(label))) == label)
        return trimmed(F.substring(F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("")), len(label) + 1, 1 << 30))

    context, words = last("CONTEXT:"), last("KEYWORDS:")
    context_line = F.when(context != "", F.concat(context, F.lit("\n"))).otherwise("")
    word_line = F.when(words != "", F.concat(F.lit("Keywords: "), words, F.lit("\n"))).otherwise("")
    return F.when((context == "") & (words == ""), chunk).otherwise(F.concat(context_line, word_line, F.lit("\n"), chunk))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm_of(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column, full: int = FULL_DIMENSION) -> Column:
    """Scaled to length 1 if shorter than the full dimension and not almost zero."""
    norm = F.sqrt(dot(v, v))
    return F.when((F.size(v) < full) & (norm >= 1e-12), F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def batch_size(provider: str, model: str) -> int:
    return BATCH_SIZES.get(f"{provider}:{model}".lower(), DEFAULT_BATCH)


def key_variable(preset: str | None) -> str | None:
    """Environment variable of a provider's API key."""
    if not preset or not preset.strip():
        return None
    name = {"CLAUDE": "ANTHROPIC", "GOOGLE": "GEMINI"}.get(preset.upper(), preset.upper())
    return f"{name}_API_KEY"


def scope_rank(mode: Column) -> Column:
    return F.when(mode == "embedding", 1).when(mode == "contextualization", 2).otherwise(3)


def skippable(old_hash: Column, new_hash: Column, status: Column) -> Column:
    """Whether a file with equal hash and a known status needs no work."""
    return old_hash.eqNullSafe(new_hash) & status.isin(0, 1, 2, 3, 4)


def folder_class(name: Column, has_config: Column, require_guid: bool = False) -> Column:
    hidden = name.startswith(".") | name.startswith("_") | F.lower(name).contains("-backup-")
    if require_guid:
        hidden = hidden | ~name.rlike(GUID)
    return F.when(hidden, "Protected").when(has_config, "LiveKb").otherwise("Orphan")


def query_tokens(query: str) -> list[str]:
    """Words of three or more UTF-16 units; those under three characters match nothing and are dropped."""
    return [t for t in query.split() if len(t.encode("utf-16-le")) >= 6 and len(t) >= 3]


def match_expression(query: str) -> str:
    """The full-text expression of a query: quoted tokens joined by OR, quotes doubled."""
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in query.split() if len(t.encode("utf-16-le")) >= 6)
