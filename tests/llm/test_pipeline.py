import collections
import hashlib
import random

import pytest
from test_dedup import WORD, near_brute
from test_others import stats, water

import corpus_pipeline
from harrow.llm.queries import tokenizer_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    random.seed(12)
    vocabulary = ["".join(random.choices("abcdeéing", k=random.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(10, 200))) for _ in range(45)]
    texts += [texts[0], texts[0].upper(), texts[3].capitalize(), texts[4] + " more", texts[5] + " and more", texts[4] + " more still"]
    texts += [None, "", "few words", "# $ % " * 20, "wow! " * 30, "A B " * 30, "same same " * 30, ("one line of the text\n" * 9), "a b " * 40, "x" * 20 + " " + "yy zz! " * 9]
    return [(i, t, "en", random.choice(["a", "a", "b", None]), len(t or "")) for i, t in zip(random.sample(range(500), len(texts)), texts, strict=True)]


def fine(text):
    """No rule rejects it."""
    t = text or ""
    n_words, chars, symbols, dup_lines, _, base = stats(t)
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, lower = (sum(a <= c <= z for c in t) for a, z in ("AZ", "az"))
    return not (base or 10 * symbols > 3 * n_words or 10 * t.count("!") > 3 * n_words or upper > lower or 2 * dup_lines > len(lines) or 100 * stutter > 30 * n_words or not 2 * n_words <= chars <= 15 * n_words)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def quality_brute(docs):
    return [d for d in docs if fine(d[1])]


def exact_brute(docs):
    last = {}
    for d in docs:
        last[lower(d[1])] = max(last.get(lower(d[1]), d), d, key=lambda x: x[0])
    return list(last.values())


def near_kept(docs):
    kept = {r[0] for r in near_brute([d[:2] for d in docs], 5) if r[3]}
    return [d for d in docs if d[0] in kept]


@pytest.fixture(scope="module")
def stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "encode"]
    return dict(corpus_pipeline.STAGES)


def run(spark, stage, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return stage(spark, df, "")


@pytest.mark.parametrize(("name", "brute"), [("quality rules", quality_brute), ("exact dedup", exact_brute), ("near dedup", near_kept)])
def test_stages_that_drop(spark, stages, name, brute):
    docs = corpus()
    out = run(spark, stages[name], docs)
    want = brute(docs)
    assert out.columns == COLUMNS and 0 < len(want) < len(docs)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_mix(spark, stages):
    docs = near_kept(exact_brute(quality_brute(corpus())))
    out = run(spark, stages["mix sources"], docs)
    assert out.columns == COLUMNS
    own, sizes, taken, words = {d[0]: d for d in docs}, collections.Counter(), collections.Counter(), collections.Counter()
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1]))
    for r in out.collect():
        d, left = own[r.doc_id], iter(WORD.findall(own[r.doc_id][1]))
        found = WORD.findall(r.text)
        assert (r.lang, r.source, r.n_chars) == (d[2], d[3], len(r.text)) and found and all(w in left for w in found)
        taken[r.source] += len(found)
        words.update((r.doc_id, w) for w in found)
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= 64
    most = {(d[0], w): 3 * n for d in docs for w, n in collections.Counter(WORD.findall(d[1])).items()}
    assert all(n <= most[k] for k, n in words.items())


def test_encode(spark, stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    ref = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes())
    docs = corpus()
    got = {r.doc_id: r for r in run(spark, stages["encode"], docs).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        ids = [*ref.encode(text or ""), ref.eos_id()]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    left = {d[0] for d in near_kept(exact_brute(quality_brute(docs)))}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= left and all(r.n_tokens > 1 for r in out)
