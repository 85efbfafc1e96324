import hashlib
import re

import numpy as np
from marquetry.llm import chat, embed, registry
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_escape_round_trip():
    cases = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<<SYS>> <</SYS>>", "<|turn|><|end|>", "<|\\turn|>", "plain", "[[INST]]", "<\\<SYS>>", "a < b </s", "\\</s>"]
    for text in cases:
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|[a-z_]+\|>", held), held


def brute_chat(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op7_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:5] for r in registry.QUERIES["op7_chat_format"](spark, SMALL).collect()}
    assert got == brute_chat(rows)


def test_chat_odd_rows_and_layout(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [
        (1, 2, "assistant", "é😀 </s>", "x"), (1, 1, None, None, "x"), (1, 1, "user", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"),
        (None, 0, "assistant", "z" * 20000, "x"), (2, None, "assistant", "", "x"), (2, 0, "<|end|>", "<|turn|>", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")
    made = chat.format_conversations(turns, path, pattern).cache()
    got = {r[0]: tuple(r)[1:5] for r in chat.conversation_digests(chat.read_conversations(made, path, pattern)).collect()}
    assert got == brute_chat(rows)
    for r in made.filter("conv_id = 1").orderBy("seq").collect():
        assert len(r.tokens) == len(r["mask"]) and set(r["mask"]) <= {0, 1}
    starts = [(r.start, len(r.tokens)) for r in made.filter("conv_id = 1").orderBy("seq").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert chat.format_conversations(turns.limit(0), path, pattern).count() == 0


def brute_links(rows):
    links, parent = {}, {}
    for k, (_, v, lab) in enumerate(rows):
        ok = v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        links[k], parent[k] = 0, k
        rows[k] = (*rows[k][:1], np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None, lab)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, la) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j][1]
            if a is not None and b is not None and la == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            r = find(k)
            low[r] = min(low.get(r, i), i)
    return sorted((i if i is not None else -1, links[k], low.get(find(k), -1) if find(k) in low else -1) for k, (i, *_) in enumerate(rows))


def planted(rng, groups=40, dim=64):
    rows = []
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 9)):
            noisy = base + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.3])
            rows.append((len(rows), [float(x) for x in noisy.astype(np.float32)], int(g % 3)))
    return rows


def test_op8_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = planted(rng)
    rows += [(None, rows[0][1], 0), (900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, rows[1][1], None), (904, rows[0][1][:10], 0), (905, [None] * 64, 0), (906, [], 0), (906, rows[0][1], 0), (907, [x * 1e-30 for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n long")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in embed.near_duplicates(frame).collect())
    want = brute_links(list(rows))
    true, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert found <= true and found >= 0.97 * true
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)
    assert embed.near_duplicates(frame.limit(0)).count() == 0


def test_cells_of_a_large_bucket_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in (base + rng.normal(size=16) * 0.05)], 1) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(tuple(r) for r in embed.near_duplicates(frame).collect())
    monkeypatch.setattr(embed, "CELL", 25)
    assert sorted(tuple(r) for r in embed.near_duplicates(frame).collect()) == whole
    assert whole[0][1] == 119 and {r[2] for r in whole} == {0}


def test_op8_loses_no_link_at_the_threshold(spark, monkeypatch):
    """Pairs at cosines just above and below the threshold, in one cell and in several."""
    rng = np.random.default_rng(21)
    one = embed.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=one.shape)
    side = embed.unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    cosine = rng.choice([0.9301, 0.9299], 3000)[:, None]
    two = cosine * one + np.sqrt(1 - cosine**2) * side
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([one, two]))], "vec_id long, embedding array<double>, label int")
    want = [int(c > 0.93) for c in cosine[:, 0]] * 2
    for cell in (embed.CELL, 1000):
        monkeypatch.setattr(embed, "CELL", cell)
        got = {r.vec_id: r.n_links for r in embed.near_duplicates(frame).collect()}
        assert [got[k] for k in range(6000)] == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = embed.unit(rng.normal(size=(400, 64)))
    turned, codes, factors = embed.binary_codes(x)
    estimate, error = embed.bounds(codes, factors, turned)
    gap = estimate - x @ x.T
    np.fill_diagonal(gap, 0)
    assert abs(gap.mean()) < 0.005
    assert (np.abs(gap) <= error[:, None]).mean() > 0.9999


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_bpe_simhash_rules_files import brute_components, brute_fingerprint

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == names
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        had = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= set(had)
        if name == "near_dedup":
            comps = brute_components({i: brute_fingerprint(t) for i, t in had.items()})
            assert ids == {i for i, c in comps.items() if i == c}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count()
    assert corpus_pipeline.run(spark, SMALL).count() == before.count()


def test_pipeline_on_clashing_and_empty_rows(spark):
    import corpus_pipeline

    rows = [(None, None, None, None, None, "a", "b"), (1, "", "en", "s", 0, "a", "b"), (2, "x y z " * 50, "en", None, 300, "a", "b"), (2, "x y z " * 50, "en", None, 300, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string")
    for part in (docs, docs.limit(0)):
        now = part
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SMALL)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count() >= 0
