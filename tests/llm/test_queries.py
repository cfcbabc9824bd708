"""The queries on small tables with nulls, empty texts, repeats and clashing columns, and on empty ones."""

import json
import zlib

import numpy as np
import pytest

from quillmap.llm import langid, mixing, quality, queries

TEXTS = ["the cat sat on the mat and looked at the dog", "le chat est assis sur la table et regarde le chien", "", None, "12 34", "word " * 4000, "the cat sat on the mat and looked at the dog"]


def rows_of(n, null_id=True):
    out = [(i, TEXTS[i % len(TEXTS)], "en" if i % 2 else "fr", [None, "", "a", "b"][i % 4]) for i in range(n)]
    out += [(3, "repeated id with another text", "en", "a"), out[1], out[1]]
    return out + [(None, "no id at all here", "en", "a"), (None, None, None, None)] if null_id else out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    text = rows_of(40)
    spark.createDataFrame([(*r, 5, 0.5, "x", 1, 2, "n") for r in text], "doc_id long, text string, lang string, source string, n_chars long, score double, row string, topic int, kept int, name string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (5, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.standard_normal(64)], i % 3) for i in range(210)]
    v += [(300, v[0][1], 0), (301, None, 1), (302, [0.0] * 64, 1), (303, [None] * 64, 2), (304, v[3][1], None), (5, v[5][1], 2), (None, v[4][1], 1)]
    spark.createDataFrame([(*r, "z") for r in v], "vec_id long, embedding array<float>, label int, shard string").write.parquet(f"{d}/embeddings.parquet")
    pages = [(i, f"http://p/{i}", ["x" * 2000, None, "", "é" * 700][i % 4], "d") for i in range(20)] + [(None, None, "x" * 2000, "d"), (3, "again", "x" * 2000, "d")]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string").write.parquet(f"{d}/pages.parquet")
    turns = [(c, t, "user" if (t + c) % 2 == 0 else "assistant", ["hello", "", None][(c + t) % 3], 1) for c in range(6) for t in range(8)] + [(None, 1, "assistant", "q", 1), (1, None, None, None, 1), (0, 1, "assistant", "hello", 1), (3, 12, "user", "late", 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, level int").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


COLUMNS = {
    "op1_graph_dedup": ["vec_id", "n_links", "component_id", "kept"], "op2_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"], "op4_packing": ["doc_id", "piece", "bin_id", "start", "n_tokens"],
    "op5_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"], "op9_topk": ["query_id", "rank", "vec_id", "distance"], "op10_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_mixing": ["doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept"], "op3_chat": ["conv_id", "turn", "part", "role", "kind", "call_id", "tool", "level", "status", "errors", "json"],
    "op11_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_toxicity": ["doc_id", "held_out", "score", "predicted", "by_language"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, small, empty, name):
    got = queries.queries()[name](spark, small)
    assert got.columns == COLUMNS[name] and queries.queries()[name](spark, empty).count() == 0
    found = got.collect()
    crc = lambda i, m: None if i is None else zlib.crc32(str(i).encode()) % m
    for op, m, k in (("op2_language_id", 4, 2), ("op5_language_model", 7, 2), ("op10_quality", 5, 0), ("op13_toxicity", 3, 1)):
        if name == op:
            assert len(found) == 45 and all(r.held_out == (crc(r.doc_id, m) == k) for r in found)
    if name == "op2_language_id":
        assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in found)
        assert {r.lang_pred for r in found if r.doc_id in (2, 4, 9, 11)} == {"und"} and [r.lang_pred for r in found].count("und") == 1 + sum(not any(map(str.isalpha, t or "")) for _, t, *_ in rows_of(40, False))
    if name == "op10_quality":
        assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    if name == "op13_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    if name == "op11_codes":
        assert len(found) == 215 and all(len(r.code) == 32 for r in found) and len({r.codebooks_sha256 for r in found}) == 1
    if name == "op12_whitening":
        assert len(found) == 215 * 32 and all(r.identity_error < 1e-4 and r.n == 215 for r in found)
    if name == "op7_simhash":
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in found) and len(found) == 45
        assert {r.fingerprint for r in found if r.doc_id in (2,)} == {"0" * 16}
    if name == "op1_graph_dedup":
        by = {r.vec_id: r for r in found}
        assert len(found) == 217 and by[300].component_id == 0 and by[300].n_links == 1 and by[302].n_links == 0
    if name == "op6_warc":
        ids = [r.page_id for r in found if r.payload_bytes == 2000 and r.record_type == "response"]
        assert ids == [16] and {r.refers_to for r in found if r.record_type == "revisit" and r.payload_bytes == 2000} == {16}
    if name == "op3_chat":
        assert {"ok", "invalid", "duplicate", "cycle", "unanswered", "orphan"} == {r.status for r in found} and {0, 1, -1} == {r.level for r in found}
        for r in found:
            assert json.dumps(json.loads(r.json), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.json
    if name == "op4_packing":
        total = sum(len((t or "").split()) for _, t, *_ in rows_of(40))
        assert sum(r.n_tokens for r in found) == total
    if name == "op8_mixing":
        assert len(found) == 45 and all(0 <= r.probability <= 1 for r in found)


def test_predictions_are_the_plain_model(spark, small):
    """op2 against the two layers applied one by one."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    for r in langid.predicted(docs, model).collect():
        grams = []
        raw = b" " + b" ".join("".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in (r.text or "").lower()).encode().split()) + b" "
        for n in (3, 4):
            for i in range(len(raw) - n + 1):
                code = 0
                for b in raw[i : i + n]:
                    code = code << 8 | b
                grams.append((code * 2654435761 % 2**32) >> (32 - langid.BITS))
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        z = (model.table[grams].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.lang_score - p.max()) < 1e-5 and r.lang_rejected == bool(r.lang_score < model.floor)


def test_votes_are_those_of_the_nearest_by_brute_force(spark, small):
    """op10 against one text and one neighbour at a time."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels, neighbours=3)
    for r in quality.scored(docs, model).collect():
        own = model.embed(quality.counts(r.text)[None])[0]
        near = [float(np.float32(own @ v)) for v in model.vectors]
        least = sorted(near, reverse=True)[2]
        votes = [(max(c, 0.0) ** model.power, y) for c, y in zip(near, model.labels) if c >= least - 1e-6]
        total = sum(w for w, _ in votes)
        assert abs(r.quality_score - (sum(w * y for w, y in votes) / total if total else 0.5)) < 1e-3


def plain_raking(cells, goals):
    """Weights of cells {(source, lang, topic): tokens} by bisection for each factor."""
    u = {c: float(n) for c, n in cells.items()}
    for _ in range(300):
        for m, goal in enumerate(goals):
            for label, aim in goal.items():
                own = [c for c in cells if c[m] == label]
                low, high = 0.0, max(cells[c] / u[c] for c in own)
                for _ in range(80):
                    f = (low + high) / 2
                    low, high = (f, high) if sum(min(cells[c], u[c] * f) for c in own) < aim else (low, f)
                for c in own:
                    u[c] *= high
    return {c: min(u[c], cells[c]) for c in cells}


def test_mixing_is_plain_raking(spark, small):
    import xxhash

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang")
    topics = mixing.learn_topics(docs)
    got, margins = mixing.mixed(docs, fraction=0.5, topics=topics)
    got, margins = got.collect(), margins.collect()
    cells = {}
    key = lambda r: (r.source, r.lang, topics.of((r.text or "").encode().lower().split(), r.lang))
    for r in got:
        assert r.n_tokens == len((r.text or "").split()) and r.topic == key(r)[2]
        if r.n_tokens:
            cells[key(r)] = cells.get(key(r), 0) + r.n_tokens
    label = lambda v: "" if v is None else f"={v}"
    goals = []
    for m, name in enumerate(mixing.MARGINS):
        there = {}
        for c, n in cells.items():
            there[c[m]] = there.get(c[m], 0) + n
        root = sum((n / sum(cells.values())) ** 0.5 for n in there.values())
        goal, open_ = {}, set(there)
        while open_:
            left, part = 0.5 * sum(cells.values()) - sum(goal.values()), sum((there[x] / sum(cells.values())) ** 0.5 / root for x in open_)
            give = {x: (there[x] / sum(cells.values())) ** 0.5 / root / part * left for x in open_}
            over = {x for x in open_ if give[x] > there[x]}
            goal |= {x: there[x] for x in over} or give
            open_ = open_ - over if over else set()
        goals.append(goal)
        told = {r.label: r for r in margins if r.margin == name}
        assert set(told) == set(map(label, there)) and all(abs(told[label(x)].goal - goal[x]) < 1e-6 * max(goal[x], 1) for x in goal)
    want = plain_raking(cells, goals)
    for r in got:
        p = want[key(r)] / cells[key(r)] if r.n_tokens else 1.0
        assert abs(r.probability - p) < 1e-3
        draw = (xxhash.xxh64_intdigest(str(r.doc_id).encode() if r.doc_id is not None else (r.text or "").encode(), 42) >> 11) * 2.0**-53
        if r.doc_id is not None or r.text is not None:
            assert r.kept == (draw < r.probability)
    # an empty and a null source are different labels
    assert {label(None), label("")} <= {r.label for r in margins if r.margin == "source"}


def test_topics_are_learned_from_all_rows(spark):
    """More rows than a sample of 4000: weights, means and centres are those of plain k-means over every one."""
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(f"word{t}x{rng.randrange(30)}" for _ in range(12)) if i % 50 else None, (None, "en", "de")[i % 3]) for i in range(5000) for t in [rng.randrange(8)]]
    got = mixing.learn_topics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1)
    counts = [(mixing.word_counts(text.encode().split()), lang) for _, text, lang in rows if text]
    n, df = len(counts), sum((c > 0).astype(int) for c, _ in counts)
    assert n == 4900 and np.allclose(got.idf, np.log((1 + n) / (1 + df)) + 1)
    x = np.log1p(np.array([c for c, _ in counts])) * got.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = [l for _, l in counts]
    means = {l: x[[m == l or l is None for m in langs]].mean(axis=0) for l in (None, "en", "de")}
    assert set(got.means) == set(means) and all(np.allclose(got.means[l], means[l], atol=1e-6) for l in means)
    # a round more moves the centres to the means of their nearest texts
    x -= np.array([means[l] for l in langs])
    assert got.centres.shape == (8, 1 << mixing.BITS)
    more = mixing.learn_topics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=2)
    at = (x @ got.centres.T).argmax(axis=1)
    want = np.array([x[at == k].mean(axis=0) if (at == k).any() else got.centres[k] for k in range(8)])
    assert np.allclose(more.centres, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-4)
    assert mixing.learn_topics(spark.createDataFrame([], "doc_id long, text string, lang string")).centres.shape[0] == 0


def test_what_a_source_can_not_give_the_others_do():
    got = mixing.feasible(np.array([68.0, 16.0, 16.0]), np.array([900.0, 50.0, 50.0]), 700.0)
    assert np.allclose(got, [600, 50, 50])
    cells, keys = np.array([500.0, 400.0, 50.0, 50.0]), [np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1])]
    w = mixing.rake(cells, keys, [got, np.array([400.0, 300.0])])
    assert np.allclose([w[:2].sum(), w[2], w[3]], [600, 50, 50]) and np.allclose([w[0] + w[2], w[1] + w[3]], [400, 300]) and (w <= cells + 1e-9).all()


def test_shares_by_value_and_joins_by_a_shuffle(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang")
    topics = mixing.learn_topics(docs)
    shares = {"source": {"a": 0.5, "b": 0.3, None: 0.2}}
    one, margins = mixing.mixed(docs, fraction=0.2, shares=shares, topics=topics)
    by = {r.label: r for r in margins.collect() if r.margin == "source"}
    assert by["="].wanted == 0 and by["="].reached == 0 and abs(by["=a"].wanted / by["=b"].wanted - 5 / 3) < 1e-9
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    two = mixing.mix(docs, fraction=0.2, shares=shares, topics=topics)
    assert sorted(map(str, two.collect())) == sorted(map(str, one.collect()))
    monkeypatch.setattr(mixing, "MOST_CELLS", 3)
    with pytest.raises(ValueError):
        mixing.mix(docs, topics=topics)
    with pytest.raises(ValueError):
        mixing.mix(docs, shares={"colour": {"red": 1.0}}, topics=topics)


def test_calls_that_no_json_reader_or_schema_expects(spark):
    """Each of these is told as invalid and none ends the job."""
    from quillmap.llm import chat

    bodies = ['{"id":"a","name":"search","arguments":{"limit":1e999}}', '{"id":"b","name":["x"]}', '{"id":"c","name":{"x":1}}', '{"id":"d","name":"search","arguments":{"query":"\\ud800"}}', '{"id":"e","name":null}', '{"id":7}', "[" * 100_000,
              '{"id":"f","name":"search","arguments":{"limit":NaN}}', '{"id":"\\udc00","name":"\\udc00"}', '{"id":"g","name":"search","arguments":' + '{"query":' * 5000 + "1" + "}" * 5000 + "}", '{"id":"h","name":"search","arguments":{"query":"x","limit":1' + "0" * 5000 + "}}"]
    turns = [(1, i, "assistant", f"<tool_call>{b}</tool_call>") for i, b in enumerate(bodies)] + [(1, 90, "user", '<tool_result>{"id":"d","content":"\\ud800"}</tool_result>'), (2, 0, "user", "long " * 400_000)]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect() if r.conv_id == 1}
    assert len(got) == 12
    assert {k: got[k].status for k in got} == {**{k: "invalid" for k in range(11)}, 3: "ok", 90: "ok"}
    for r in got.values():
        assert json.loads(r.json) is not None
    assert got[3].json == '{"arguments":{"query":"\\\\ud800"},"id":"d","name":"search"}' or json.loads(got[3].json)["arguments"]["query"] == "\ud800"


def test_mixing_keeps_columns_of_any_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "a", 1, 2, 3, True, "t", 0.5) for i in range(30)],
                                 "doc_id long, text string, lang string, source string, __p int, __tokens int, __source int, Kept boolean, Topic string, `a.b` double")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "__p", "__tokens", "__source", "a.b", "topic", "n_tokens", "probability", "kept"]
    got.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 30 and all((r["__p"], r["__tokens"], r["__source"], r["a.b"]) == (1, 2, 3, 0.5) for r in rows)


def test_a_repeated_id_has_one_place_in_the_sample(spark):
    hot = spark.sql("select id from range(400) order by xxhash64(id) limit 1").first().id
    rows = [(i, f"clean text number {i} of many") for i in range(400) if i != hot] + [(hot, f"junk {k}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0) if i != hot else 1) for i in range(400)] + [(hot, 1)] * 50, "doc_id long, quality int")
    model = quality.fit(docs, labels, sample_rows=200)
    assert len(model.labels) == 200 and model.labels.sum() == 100


def test_very_long_texts(spark):
    long = "the cat sat on the mat and looked at the dog " * 60_000
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "word" * 500_000, "en", "b"), (3, "der Hund sah die Katze", "de", "a")], "doc_id long, text string, lang string, source string")
    assert langid.predicted(docs, langid.fit(docs)).count() == 3
    assert quality.scored(docs, quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))).count() == 3
    assert {r.doc_id: r.n_tokens for r in mixing.mix(docs).collect()} == {1: 660_000, 2: 1, 3: 5}


def test_mixing_counts_words_without_a_list_of_them(monkeypatch):
    """Texts are counted twice in a run; word by word in Python that alone took most of the budget."""
    from quillmap.llm.text import lower_words

    texts = [None, "", " \n", "a", "ab abc ABCD abcdefg abcdefgh abcdefghijk", "  x\x1cyz\x0b\x0cÄÖÜ ÄÖ\x85zz\u00a0\t\r\n", "one " * 70_000, "é" * 300, "abc"]
    for text in texts:
        words = lower_words(text)
        counts, n = mixing.text_counts((text or "").encode())
        assert n == len(words) and np.array_equal(counts, mixing.word_counts(words)), text
