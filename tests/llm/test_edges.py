"""Empty tables, repeated rows, clashing columns and texts past a piece, for every operator."""

import hashlib
import os
import random

import pytest

from harrow.llm import automaton, bytesx, exact, html, mixing, near, pieces, pii, ppm, quality, suffix
from harrow.llm.queries import tokenizer_bytes

WORDS = [f"w{i:03d}" for i in range(500)]
OPERATORS = {
    "exact": lambda d: exact.exact_groups(d),
    "ppm": lambda d: ppm.score(d),
    "suffix": lambda d: suffix.drop_repeated_bytes(d, keep="none"),
    "pieces": lambda d: pieces.encode_texts(d, tokenizer_bytes()),
    "automaton": lambda d: automaton.drop_repeated_words(d),
    "quality": lambda d: quality.quality(d),
    "mixing": lambda d: mixing.taken_words(*mixing.mix_plan(d)),
    "html": lambda d: html.extract(d, "doc_id", "text", ()),
    "near": lambda d: near.near_groups(d),
    "pii": lambda d: pii.pseudonymise(d, b"key"),
}
STAGES = {
    "exact": lambda d: exact.drop_exact(d),
    "near": lambda d: near.drop_near(d),
    "quality": lambda d: quality.filter_quality(d),
    "mixing": lambda d: mixing.mixed(d),
}
#: Names that the operators themselves use.
CLASH = ["id", "rid", "h", "n", "key", "size", "taken", "kept", "g", "t", "m", "x", "c", "held", "n_tokens", "component_id", "text_sha256", "n_words", "keep_id", "n_chars"]


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    shared = passage(0, 120)
    texts = [f"{shared} {passage(i, 20)}" for i in range(1, 4)] + [None, "", "  ", "one", shared, shared]
    data = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[0], data[0], data[3]], "doc_id long, text string, source string")


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, table, name):
    assert OPERATORS[name](table.where("doc_id < 0")).collect() == []
    if name in STAGES:
        out = STAGES[name](table.where("doc_id < 0"))
        assert out.collect() == [] and out.columns == table.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_clashing_columns(spark, table, name):
    out = OPERATORS[name](table)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == table.count()
    if name != "mixing":  # rows alike get like results
        first = [r for r in rows if r[0] == 0]
        assert len(first) == 3 and len(set(map(str, first))) == 1
    wide = table.selectExpr("*", *(f"cast(1 as int) as `{c}`" for c in CLASH))
    again = OPERATORS[name](wide)
    assert again.columns == out.columns
    if name != "mixing":
        assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in again.collect())
    else:
        assert sorted(map(str, (r[:4] for r in rows))) == sorted(str(tuple(r)[:4]) for r in again.collect())
    if name in STAGES:
        kept = STAGES[name](wide)
        assert kept.columns == wide.columns and kept.count() == STAGES[name](table).count()


def test_texts_past_a_piece(spark):
    long = passage(7, 140_000)
    assert len(long) > bytesx.PIECE
    words = long.split()
    other = words.copy()
    other[70_000:70_040] = passage(8, 40).split()
    tail = passage(9, 200)
    docs = spark.createDataFrame([(1, long), (2, " ".join(other)), (3, tail + " " + " ".join(words[139_800:])), (4, "short " + tail)], "doc_id long, text string")
    near_rows = {r.doc_id: r for r in near.near_groups(docs).collect()}
    assert {i: r.component_id for i, r in near_rows.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert near_rows[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    kept = {r.doc_id: r for r in automaton.drop_repeated_words(docs).collect()}
    assert kept[1].n_removed == 0 and kept[4].n_removed == 200 and kept[3].n_removed == 200
    assert 139_900 <= kept[2].n_removed <= 139_960 and kept[2].n_words == 140_000
    cut = {r.doc_id: r for r in suffix.drop_repeated_bytes(docs, keep="none").collect()}
    before = len(os.path.commonprefix([long, " ".join(other)]))
    after = len(os.path.commonprefix([long[::-1], " ".join(other)[::-1]]))
    assert cut[1].n_removed == before + after and cut[1].n_spans == 2
    assert cut[3].n_spans == 1 and cut[3].n_removed == cut[3].n_bytes and cut[4].n_removed == len(tail)
    scores = {r.doc_id: r for r in ppm.score(docs).collect()}
    assert scores[1].n_tokens == 140_001 and scores[1].score < 0 and scores[1].score > scores[1].base_score * 2
    coded = {r.doc_id: r for r in pieces.encode_texts(docs, tokenizer_bytes()).collect()}
    assert coded[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
