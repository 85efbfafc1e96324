import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from marquetry.llm import bpe, registry, rules, simhash, token_files
from marquetry.llm.tokenizer import WordCodec, default_path
from marquetry.operators.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "one", "Straße ΟΔΟΣ  İstanbul\t tab\x0b\x1c nbsp x", "a<|endoftext|>b <|startoftext|>",
    "don't we'll THEY'RE 'tis", "é combining ̸x", "汉字 and emoji 😀 end", "x" * 5000, ("word " * 3000).strip(), "12345 6.7%%%!! | a",
    "ͅᾳ   line", "A\r\nB  C ",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, component_id string"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en", "s", 1, "f", "w", "c") for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def lib():
    return WordCodec(default_path())


def corpus(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def expected_ids(lib, text):
    return lib.library.encode(text or "", add_special_tokens=False).ids


def test_word_codec_is_the_library(spark, lib):
    for text in [*ODD, *list(corpus(spark).values())[:80]]:
        ids = expected_ids(lib, text)
        assert np.frombuffer(lib.encode(text or ""), "<u4").tolist() == ids
        assert lib.decode(lib.encode(text or "")) == lib.library.decode(ids, skip_special_tokens=False)


def test_chunked_encoding_is_exact_and_reuses_chunks(spark, lib):
    store = bpe.ChunkStore(lib)
    texts = [t or "" for t in ODD] + list(corpus(spark).values())[:60]
    random.seed(3)
    long = [t for t in texts if len(t) > 3000]
    texts += [long[0] + " changed " + long[1], "new head " + long[0]]
    for text in texts:
        for mean in (64, 512, 2048):
            assert np.frombuffer(bpe.encode_text(text, store, mean), "<u4").tolist() == expected_ids(lib, text)
    assert store.reused > 0


def test_cut_points_cover_and_are_content_defined():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()
    cuts = bpe.cut_points(text)
    assert cuts[-1] == len(text) and cuts == sorted(set(cuts))
    moved = bpe.cut_points(b"0123456789" * 13 + text)
    assert len({c + 130 for c in cuts} & set(moved)) > 0.9 * len(cuts)
    assert bpe.cut_points(b"") == []


def test_op3_rows(spark, lib):
    want = {}
    for i, t in corpus(spark).items():
        ids = expected_ids(lib, t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op3_bpe"](spark, SF).collect()}
    assert got == want


def test_encode_then_decode_frames(spark, lib):
    docs = frame(spark, ODD)
    encoded = bpe.encode_documents(docs, default_path())
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: expected_ids(lib, t) for i, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, default_path()).collect()}
    assert back == {i: lib.library.decode(expected_ids(lib, t), skip_special_tokens=False) for i, t in enumerate(ODD)}


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op4_against_brute_force(spark):
    prints = {i: brute_fingerprint(t) for i, t in corpus(spark).items()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in brute_components(prints).items()}
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op4_simhash"](spark, SF).collect()}
    assert got == want


def test_simhash_links_are_complete(spark):
    """Random walks of up to five changed bits, a large group and exact pairs."""
    rng = random.Random(11)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(3)]
    hub = rng.getrandbits(64)
    fps += [hub ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(150)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"))
    from marquetry.operators.components import connected_components

    got = {r.id: r.component for r in connected_components(pairs).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_odd_rows(spark):
    texts = [None, "", "\t \n", "a b c d e", "a b c d e", "A B c d e", "other words stand here now"]
    ids = [7, 3, None, 9, 9, None, None]
    rows = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    by = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in rows)
    assert [(a, c) for n, a, m, c in by if not n] == [(3, 3), (7, 3), (9, 9), (9, 9)]
    assert sorted((m, c) for n, a, m, c in by if n) == [(False, 3), (False, 9), (True, 0)]
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    kept = simhash.keep_representatives(frame(spark, texts, ids))
    assert kept.columns == frame(spark, texts).columns


def test_representatives_are_chosen_by_row(spark):
    texts = {"A": "a b c d e", "a": "A B c d e", "B": "other unique words stand here", "N": "rows without any id at all", "M": "null ids here name nothing else"}
    rows = [(1, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "N"), (None, "N"), (None, "M"), (7, "M"), (7, "M"), (1, "a"), (8, "B")]
    docs = frame(spark, [texts[t] for _, t in rows], [i for i, _ in rows])
    got = simhash.keep_representatives(docs).select("doc_id", "text").collect()
    want = [(1, texts["a"]), (5, texts["B"]), (7, texts["M"]), (None, texts["N"])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def brute_measures(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams, hit = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_op5_measures_and_odd_rows(spark):
    texts = [*ODD, "a b c d e f g h " * 4, ("l1 x\nl1 x\n \n\nl2\n" * 3) + "tail", "#*$ %&|<> a"]
    got = {r.doc_id: tuple(r)[1:7] for r in rules.quality_rules(frame(spark, texts)).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}
    real = corpus(spark)
    got = {r.doc_id: tuple(r)[1:7] for r in registry.QUERIES["op5_quality_rules"](spark, SF).collect()}
    assert got == {i: brute_measures(t) for i, t in real.items()}
    assert rules.quality_rules(frame(spark, []).limit(0)).count() == 0


def test_rules_adapt_to_the_group(spark):
    """The same share of symbols passes where it is usual and fails where it is not."""
    plain = " ".join(f"word{i}" for i in range(60))
    marked = " ".join(f"wo|rd{i}" for i in range(60))
    rows = [(i, plain, "en", "a", 0) for i in range(60)] + [(100, marked, "en", "a", 0)]
    rows += [(200 + i, marked, "en", "b", 0) for i in range(60)]
    rows += [(300, plain, None, None, 0), (301, plain, "en", "tiny", 0)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[100] and got[200] and got[0] and got[300] and got[301]


def test_op6_against_brute_force(spark, lib):
    want, start = {}, 0
    for i, t in sorted(corpus(spark).items()):
        ids = [*expected_ids(lib, t), 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in registry.QUERIES["op6_token_files"](spark, SF).collect()} == want


def test_token_files_layout(spark, tmp_path, lib):
    import glob

    import pyarrow.parquet as pq

    docs = frame(spark, ODD)
    token_files.write_token_files(docs, str(tmp_path / "t"), default_path())
    seen = []
    for f in sorted(glob.glob(str(tmp_path / "t" / "part-*"))):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(0)
            assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index
            assert any("DICTIONARY" in x for x in meta.row_group(g).column(2).encodings)
        seen += pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
    assert seen == sorted(seen)
    files = token_files.read_token_files(spark, str(tmp_path / "t"))
    some = {r.doc_id: list(r.tokens) for r in files.filter("doc_id in (5, 6)").select("doc_id", "tokens").collect()}
    assert some == {i: [*expected_ids(lib, ODD[i]), 2] for i in (5, 6)}
    token_files.write_token_files(docs.limit(0), str(tmp_path / "e"), default_path())
    assert token_files.document_starts(token_files.read_token_files(spark, str(tmp_path / "e"))).count() == 0


def test_large_keys_are_cut_in_cells(spark):
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 2**62))
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2)) if a != b}
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(sorted(values))], "fp long, rep long")
    got = connected_components(simhash.links(rows, cell=16)).collect()
    assert len(got) == len(values) and {r.component for r in got} == {0}


def test_many_texts_at_once_are_the_library(lib):
    rng = random.Random(6)
    letters = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 0x0A, 0x0D, 0x09, 0x300, 0x3A3, 0x4E2D, 0x1F600, 0x200B]]
    texts = [None, "", " "] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choices("aeinorst", k=rng.randrange(1, 90))) + rng.choice(["", ".", "!!", "'s"]) for _ in range(400)] + ["&" * 3000, "<|endoftext|>", "x<|endoftext|>y"]
    flat, sizes = lib.encode_many(texts)
    want = [expected_ids(lib, t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    decoded = lib.decode_many(flat, sizes).to_pylist()
    assert decoded == [lib.library.decode(w, skip_special_tokens=False) for w in want]
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]):  # each plain letter, inside a word and alone
        assert np.frombuffer(lib.encode(f"{c} a{c}b"), "<u4").tolist() == expected_ids(lib, f"{c} a{c}b")


def test_slices_hold_whole_texts_in_order():
    import pyarrow as pa

    from marquetry.llm.tokenizer import slices, text_slices

    texts = ["x" * n for n in (5, 0, 300, 2, 2, 2)] + [None]
    parts = list(text_slices(pa.array(texts), most_bytes=10, most_rows=3))
    assert [t for p in parts for t in p.to_pylist()] == texts and max(map(len, parts)) <= 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    assert [i for b in slices(batch, most_bytes=10) for i in b.column(0).to_pylist()] == list(range(7))
    assert list(text_slices(pa.array([], pa.string()))) == []
