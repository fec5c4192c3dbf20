"""Native Column functions for answer normalization, scoring and prompt text.

Everything here is a Catalyst expression (no Python UDF), so it stays inside
whole-stage codegen and runs on any cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ASCII punctuation removed by normalize (Python's string.punctuation, 32 chars):
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Separator between a passage title and its text in the encoder input:
TITLE_SEP = "[SEP]"
# Prompt template pieces (context block entries are "[DOC i] title\ntext", joined by a blank line):
PROMPT_HEAD = "You are a QA system. Answer questions based on the provided documents.\n\n"
PROMPT_QUESTION = "Question: "
PROMPT_DOCS = "\n\nRelevant documents:\n"
PROMPT_TAIL = ("\n\nAnswer the question as concisely as possible. "
               "Provide only the answer, no explanation needed.")
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (29 code points: Unicode White_Space plus
# the ASCII information separators U+001C..U+001F), derived from Python itself.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# One regex character class for the punctuation set (every character escaped).
_PUNCT_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Remove leading/trailing whitespace exactly like Python's ``str.strip()``.

    ``btrim`` with an explicit set only touches the edges (no scan of the whole text).
    """
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize(c) -> Column:
    """null -> ''; lower-case; strip edge whitespace; then delete ASCII punctuation.

    Strip happens before punctuation removal, so ``"  foo . "`` becomes ``"foo "``.
    """
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.regexp_replace(py_strip(F.lower(c)), _PUNCT_CLASS, "")


def exact_match(pred, gold) -> Column:
    """1 if the normalized strings are equal, else 0."""
    return (normalize(pred) == normalize(gold)).cast("int")


def cover_exact_match(pred, gold) -> Column:
    """1 if the normalized gold is a substring of the normalized prediction.

    A missing gold normalizes to '' which every prediction contains.
    """
    return normalize(pred).contains(normalize(gold)).cast("int")


def passage_text(title, text) -> Column:
    """Encoder input of a passage: ``title[SEP]text`` when titled, else ``text``; stripped."""
    t = F.coalesce(_col(title).cast("string"), F.lit(""))
    x = F.coalesce(_col(text).cast("string"), F.lit(""))
    return py_strip(F.when(F.length(t) > 0, F.concat(t, F.lit(TITLE_SEP), x)).otherwise(x))


def context_block(contexts) -> Column:
    """``[DOC i] title\\ntext`` for each context (1-based), joined by a blank line."""
    def one(c, i):
        return F.concat(F.lit("[DOC "), (i + 1).cast("string"), F.lit("] "),
                        F.coalesce(c["title"].cast("string"), F.lit("")), F.lit("\n"),
                        F.coalesce(c["text"].cast("string"), F.lit("")))
    arr = F.coalesce(_col(contexts), F.array())
    return F.array_join(F.transform(arr, one), "\n\n")


def build_prompt(question, contexts) -> Column:
    """The fixed QA prompt over an ordered ``array<struct<title,text,...>>`` of contexts."""
    q = F.coalesce(_col(question).cast("string"), F.lit(""))
    return F.concat(F.lit(PROMPT_HEAD), F.lit(PROMPT_QUESTION), q, F.lit(PROMPT_DOCS),
                    context_block(contexts), F.lit(PROMPT_TAIL))
