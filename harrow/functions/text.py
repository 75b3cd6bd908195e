"""Text functions as column expressions: no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.normal import ENTITIES

#: Characters that Python's \\s and \\w match, as classes of Java's expressions.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NULL_TEXT = "<NULL>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def normalize_html_text(c: Column | str) -> Column:
    return F.coalesce(collapse(c), F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Lower case, everything but word characters to spaces."""
    return F.coalesce(collapse(F.lower(F.regexp_replace(col(c), f"[^{WORD}{SPACE}]", " "))), F.lit(""))


def squad_normalize(c: Column | str) -> Column:
    """Lower case, ASCII punctuation dropped, articles dropped, white space collapsed."""
    bare = F.regexp_replace(F.lower(col(c)), PUNCTUATION, "")
    return F.coalesce(collapse(F.regexp_replace(bare, f"(?<![{WORD}])(a|an|the)(?![{WORD}])", " ")), F.lit(""))


def squad_tokens(c: Column | str) -> Column:
    return F.filter(F.split(squad_normalize(c), " "), lambda t: t != "")


def once(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(tokens: Column) -> Column:
    """The tokens of an array, each with the number of earlier equal ones, in the order of tokens."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(at: Column) -> Column:
            def run(v: Column, j: Column) -> Column:
                end = F.coalesce(F.get(at, j + 1), F.size(s))
                return F.transform(F.sequence(v, end - 1), lambda k: F.concat(F.get(s, v), F.lit(" "), (k - v).cast("string")))

            return F.flatten(F.transform(at, run))

        return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(once(starts, runs))

    return once(F.array_sort(tokens), of)


def overlap(gold: Column, pred: Column) -> Column:
    """Size of the multiset intersection of two arrays of tokens without spaces; linear but for the sorts."""
    return F.size(F.array_intersect(numbered(gold), numbered(pred)))


def token_scores(gold: Column, pred: Column) -> Column:
    """struct(f1, precision, recall) of two token arrays; both empty: 1, one empty or nothing shared: 0."""

    def scores(x: Column) -> Column:
        n, g, p = x["n"].cast("double"), x["g"], x["p"]
        both, none = (g == 0) & (p == 0), (g == 0) | (p == 0) | (n == 0)

        def score(value: Column) -> Column:
            return F.when(both, 1.0).when(none, 0.0).otherwise(value)

        precision, recall = F.try_divide(n, p), F.try_divide(n, g)
        return F.struct(score(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), score(precision).alias("precision"), score(recall).alias("recall"))

    return once(F.struct(overlap(gold, pred).alias("n"), F.size(gold).alias("g"), F.size(pred).alias("p")), scores)


def is_url(c: Column | str) -> Column:
    return F.coalesce(F.lower(col(c)).rlike("^https?://"), F.lit(False))


def is_not_null(c: Column | str) -> Column:
    """Of a text: not null, not the null text, not blank."""
    return F.coalesce((col(c) != NULL_TEXT) & (collapse(c) != ""), F.lit(False))


def is_not_null_list(c: Column | str) -> Column:
    """Of a list: has an element that is neither null nor NaN."""
    return F.coalesce(F.exists(col(c), lambda x: x.isNotNull() & ~F.isnan(x.try_cast("double"))), F.lit(False)) | F.coalesce(F.exists(col(c), lambda x: x.isNotNull() & x.try_cast("double").isNull()), F.lit(False))


def is_schema(c: Column | str) -> Column:
    """Whether a query is a schema: dict keys, a bracketed text, or two colons or more."""
    x = F.trim(F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    braces = (F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}"))) | (F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))
    return F.coalesce(F.startswith(x, F.lit("dict_keys(")) | braces | (F.regexp_count(x, F.lit(":")) >= 2), F.lit(False))


def website_of(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("_"), F.lit(1))


def websrc_domain_key(c: Column | str) -> Column:
    return F.substring(col(c), 1, 2)


def websrc_page(c: Column | str) -> Column:
    """An id without a number is an error, as on the side of the pages."""
    return F.substring(col(c), 3, 7).cast("int")


def yes_no_probability(yes: Column | str, no: Column | str) -> Column:
    """e^yes / (e^yes + e^no); a missing log probability is -10, 0 / 0 is 0."""
    y, n = F.exp(F.coalesce(col(yes), F.lit(-10.0))), F.exp(F.coalesce(col(no), F.lit(-10.0)))
    return F.coalesce(F.try_divide(y, y + n), F.lit(0.0))


def truncated_ids(ids: Column | str, suffix: Column, most: int = 8192) -> Column:
    return F.concat(F.slice(col(ids), 1, most), suffix)


def chunk_structs(idx: Column | str, chunks: Column | str) -> Column:
    """Chunks with their ids "<idx>-<place from 1>"."""
    return F.transform(col(chunks), lambda c, i: F.struct(F.concat_ws("-", col(idx).cast("string"), (i + 1).cast("string")).alias("chunkid"), c.alias("chunkcontent")))


def error_chunk(idx: Column | str, message: Column | str) -> Column:
    return F.array(F.struct(F.concat(col(idx).cast("string"), F.lit("-err")).alias("chunkid"), col(message).alias("chunkcontent")))


JUDGE = "Decide whether the document meets the needs of the query under the instruction. Answer only yes or no."
INSTRUCTION = "Given a query that names the values to extract, find parts of the page that hold them."


def chat_messages(query: Column | str, document: Column | str, instruction: str = INSTRUCTION) -> Column:
    user = F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), col(query), F.lit("\n<Document>: "), col(document))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(JUDGE).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def prompt(template: str, **values: Column | str) -> Column:
    """template with {name} replaced once each, in one pass; doubled braces stand for one."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(col(values[name]), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def clean_text(page: Column | str) -> Column:
    """A page's text without scripts, styles, headers, footers and comments, by expressions only.

    For pages whose raw elements are closed; knows the references in ENTITIES.
    """
    out = F.regexp_replace(col(page), r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<header.*?</header>|<footer.*?</footer>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.coalesce(collapse(out), F.lit(""))


def match_exact(gold: Column | str, pred: Column | str) -> Column:
    """Comparison of a plain gold text (no literal, no references) with a text: equal when normalised; no gold matches no prediction."""
    return F.when(~is_not_null(gold), ~is_not_null(pred)).otherwise(normalize_text(gold) == normalize_text(F.coalesce(col(pred), F.lit("none"))))
