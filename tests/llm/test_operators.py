"""Every operator on odd small tables, against the brute-force versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import common, components, language, lines, minhash, mixing, packing, queries, repeats, simhash, substrings, suffixes, tokens, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint int, size string, component_id string, block int, __x int"


def docs_of(spark, texts, sources=None):
    """documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, sources[i] if sources else f"s{i % 3}", None if t is None else len(t), 1, "x", "y", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rnd, n, vocabulary=40):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies, shared passages, nulls, empty and odd texts, and one long text."""
    rnd = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(55))
    base = [" ".join(f"u{rnd.randrange(9999)}" for _ in range(rnd.randrange(5, 300))) for _ in range(25)]
    texts = [None, "", " ", "\n\n\n", "one", "a b c", "Ünïcödé ß é 漢字 \U0001f600 text", "tab\tand\x0bfeed\x0c end\r\n", "\x1c\x1d\x85　nbsp here"]
    texts += base + base[:6] + [b.replace("u1", "v1") for b in base[:8]]
    texts += [f"{base[0]} {passage} {base[1]}", f"{passage} tail", f"head\n{passage}", " ".join(["same"] * 80), " ".join(["same"] * 45)]
    texts += ["l1\nl2\nl3\nl4", "x\nl2\nl3\ny", "l3\nl4\nl3\nl4\n", "l2\nl3"]
    texts.append(" ".join(words(rnd, 20_000, 3000)))
    rnd.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).repartition(5)


def by_doc(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def library(name):
    return tokens.tokenizer(queries.tokenizer_file(name))


def test_token_counts_equal_the_library(docs, texts):
    found = by_doc(tokens.token_counts(docs, queries.tokenizer_file("byte_bpe_50k.json")), "n_bytes", "n_tokens", "over_limit")
    code = library("byte_bpe_50k.json")
    for i, t in enumerate(texts):
        n = len(code.encode(t or "", add_special_tokens=False).ids)
        assert found[i] == (len((t or "").encode()), n, n > 512)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "²", "ş", "İ", ".", ",", "\x1c", "\x85", "　", " ", "\0", "<|endoftext|>", "<|startoftext|>", "́", "\r\n"]), max_size=14))
def test_pieces_change_no_encoding(parts):
    text = "".join(parts)
    assert tokens.count_tokens([text], queries.tokenizer_file("byte_bpe_50k.json"))[0] == len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)
    assert tokens.word_ids(text, queries.tokenizer_file("word_bpe_49k.json")) == np.array(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["word", "it's", "x1", "\n", "  ", "<|endoftext|>"]) for _ in range(4000))
    parts = list(tokens.safe_parts(text, 500))
    code = library("byte_bpe_50k.json")
    assert len(parts) > 5 and "".join(parts) == text
    assert sum(len(code.encode(p, add_special_tokens=False).ids) for p in parts) == len(code.encode(text, add_special_tokens=False).ids)


def test_full_caches_are_turned_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    path = queries.tokenizer_file("word_bpe_49k.json")
    memory = tokens.Encodings(path, len, False)
    for text in ("a b c", "d e f g h", "a h"):
        assert memory.of(text.split()) == [len(library("word_bpe_49k.json").encode(w, add_special_tokens=False).ids) for w in text.split()]


def test_substrings_equal_brute_force(docs, texts):
    found = by_doc(substrings.substring_dedup(docs), "n_words", "n_removed", "kept_sha256")
    want = brute.words(enumerate(texts))
    assert found == {d: (w[0], w[1], w[3]) for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 500


def test_suffixes_equal_brute_force(docs, texts):
    assert by_doc(suffixes.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(enumerate(texts))


def test_kept_texts_are_what_the_digest_is_of(docs):
    import hashlib

    for r in substrings.substring_dedup(docs).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    for r in suffixes.suffix_dedup(docs).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_dense_repeats_over_a_small_alphabet(spark):
    """Few distinct words, so that windows meet by chance in many contexts; seeds, sides and levels all matter."""
    rnd = random.Random(5)
    texts = [" ".join(words(rnd, rnd.randrange(0, 120), 2)) for _ in range(60)]
    found = by_doc(substrings.substring_dedup(docs_of(spark, texts), 8), "n_words", "n_removed", "kept_sha256")
    assert found == {d: (w[0], w[1], w[3]) for d, w in brute.words(enumerate(texts), 8).items()}
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 160))) for _ in range(60)]
    found = by_doc(suffixes.suffix_dedup(docs_of(spark, texts), 14, 5), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.strings(enumerate(texts), 14)


def test_crowded_keys(spark, monkeypatch):
    """The way for hot groups, forced on small ones, gives the same results."""
    monkeypatch.setattr(repeats, "KEY_ROWS", 3)
    rnd = random.Random(11)
    line = " ".join(f"hot{i}" for i in range(12))
    texts = [f"{' '.join(words(rnd, 15, 500))} {line} {' '.join(words(rnd, 15, 500))}" for _ in range(40)]
    texts += texts[:5] + [t.replace("w1", "v1") for t in texts[:10]] + [texts[0]] * 9
    df = docs_of(spark, texts).repartition(6)
    assert by_doc(suffixes.suffix_dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(enumerate(texts))
    found = by_doc(substrings.substring_dedup(df), "n_words", "n_removed", "kept_sha256")
    assert found == {d: (w[0], w[1], w[3]) for d, w in brute.words(enumerate(texts)).items()}


@pytest.mark.parametrize("limits", [(50, 1 << 19), (1 << 21, 40)])
def test_anchors_are_cut_out_in_parts(spark, monkeypatch, limits):
    monkeypatch.setattr(repeats, "CUT_TOKENS", limits[0])
    monkeypatch.setattr(repeats, "CUT_WINDOWS", limits[1])
    rnd = random.Random(12)
    texts = [" ".join(words(rnd, 90, 6)) for _ in range(8)]
    texts += texts[:3] + [texts[4][20:160] + texts[5]]
    assert by_doc(suffixes.suffix_dedup(docs_of(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(enumerate(texts))
    found = by_doc(substrings.substring_dedup(docs_of(spark, texts), 8), "n_words", "n_removed", "kept_sha256")
    assert found == {d: (w[0], w[1], w[3]) for d, w in brute.words(enumerate(texts), 8).items()}


def test_every_repeat_comes_out_of_the_method(spark):
    """What is removed was met as neighbours in a sorted suffix array, or survived all levels; nothing is settled before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.selectExpr("doc_id doc", "coalesce(text, '') text")
    for shape, tokenize, method, operator in (
        (repeats.Shape(100, 32), suffixes.bytes_of, suffixes.suffix_sorted, suffixes.suffix_dedup),
        (repeats.Shape(20, 5), substrings.words_of, substrings.doubling, substrings.substring_dedup),
    ):
        listed = repeats.recurring(common.materialize(repeats.scan(rows, shape, tokenize)), "seed").groupBy("doc").agg(F.collect_list("place").alias("places"))
        gone = set()
        for r in method(rows.join(listed, "doc"), shape).collect():
            gone |= {(r["doc"], i) for i in range(r["start"], r["end"])}
        assert len(gone) == sum(r["n_removed"] for r in operator(docs).collect()) > 1000


def test_documents_longer_than_a_part(spark, monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(repeats, "MOST_TOKENS", 200)
    long = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    texts = [long, long[500:1700], long[:333] + "xyz" + long[333:]]
    assert by_doc(suffixes.suffix_dedup(docs_of(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(enumerate(texts))


def test_repeated_rows_and_null_ids_are_no_later_places(spark):
    text = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in substrings.substring_dedup(df).collect()) == [(1, 0), (1, 0), (2, 40), (99, 40)]
    assert sorted((r["doc_id"] or 99, r["n_removed"] > 0) for r in suffixes.suffix_dedup(df).collect()) == [(1, False), (1, False), (2, True), (99, True)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200).map(lambda b: bytes(x % 3 for x in b)), st.integers(8, 20))
def test_deep_shallow_order(data, length):
    """Equal to Python's own stable sort, with and without the tries at work, within groups and without."""
    raw = np.frombuffer(data + bytes(length), dtype=np.uint8)
    at = np.arange(len(data))
    keys = [raw.tobytes()[i : i + length] for i in range(len(data))]
    for shallow in (8, 16, length):
        for group in (None, at % 3):
            order, begins = suffixes.deep_shallow(raw, at, length, shallow, group)
            full = [(0 if group is None else i % 3, keys[i]) for i in range(len(data))]
            assert order.tolist() == sorted(range(len(data)), key=lambda i: full[i])
            assert begins.tolist() == [k for k in range(len(order)) if not k or full[order[k]] != full[order[k - 1]]]


def test_packing_is_gapless_whole_and_tight(docs, texts):
    rows = packing.best_fit_packing(docs, queries.tokenizer_file("word_bpe_49k.json"), 256).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == brute.pieces(enumerate(texts), library("word_bpe_49k.json"), 256)
    check_sequences(rows, 256)


def check_sequences(rows, capacity):
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_in_several_rounds(spark):
    rnd = random.Random(2)
    lengths = [min(4096, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(4000)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, 4096, block=500).collect()
    assert len(rows) == 4000 and check_sequences(rows, 4096) <= 1.02 * sum(lengths) / 4096 + 2


def test_mixing_targets_and_takes(spark):
    rnd = random.Random(4)
    sources = [rnd.choice(["b", "a", None, "é", "Z"] + ["hot"] * 4) for _ in range(600)]
    texts = [None if rnd.random() < 0.02 else " ".join(words(rnd, rnd.randrange(0, 60))) for _ in range(600)]
    rows = mixing.mix_to_weights(docs_of(spark, texts, sources)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode().split()) and r["taken"] <= 3 * r["size"] and r["source"] == sources[r["doc_id"]]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute.shares(size)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - target[s]) <= 60 for s in want)
    again = mixing.mix_to_weights(docs_of(spark, texts, sources).repartition(7))
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)
    copies = Counter(r["doc_id"] for r in mixing.mixture(docs_of(spark, texts, sources)).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_simhash_components_equal_brute_force(spark, docs, texts):
    found = {r["doc_id"]: (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == brute.near_texts(enumerate(texts))
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, c in found.values()}


@pytest.mark.parametrize("rows", [simhash.CELL_ROWS, 3])
def test_every_pair_of_near_fingerprints_shares_a_cell(spark, rows):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    for p in prints[:200]:
        q = p
        for b in rnd.sample(range(64), rnd.randrange(1, 6)):
            q ^= 1 << b
        prints.append(q)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(np.array(p, dtype=np.uint64).astype(np.int64).item(), i) for i, p in enumerate(prints)], "fp long, cid long")
    grid = simhash.split_cells(simhash.cells(df), rows).repartition("cell").sortWithinPartitions("cell", simhash.F.col("home").desc(), "cid")
    links = [(r["a"], r["b"]) for r in grid.mapInArrow(lambda b: simhash.linked(b, 3), "a long, b long").collect()]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert brute.reach(range(len(prints)), links) == brute.reach(range(len(prints)), near)


def test_components_of_long_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (140, 100), (100, 140)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = {n: c for n, c in brute.reach({x for p in links for x in p}, links).items() if n != c or any(n in p and p[0] != p[1] for p in links)}
    assert {k: v for k, v in found.items() if k != v} == {k: v for k, v in want.items() if k != v}
    assert components.components(df.limit(0)).count() == 0


def test_language_on_held_out_texts(spark):
    rnd = random.Random(9)
    alphabets = {"aa": "abcde", "bb": "cdefgh", "ж": "жзийк"}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(alphabets))
        rows.append((i, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randrange(2, 8))) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "", None), (902, "123 --- \U0001f600", "bb"), (903, "A", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(df.filter("doc_id % 4 <> 2"))
    assert set(profiles) == set(alphabets)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, profiles).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, s in found.values())
    assert [found[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    held = [(lang, found[i][0]) for i, _, lang in rows if i % 4 == 2 and i < 900]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert language.learn(df.limit(0)) == {} and {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}


def test_grams_are_those_of_each_text_alone():
    import pyarrow as pa

    texts = ["ab c", None, "", "É-é", "x"]
    keys, starts = language.grams(pa.array(texts))

    def direct(text):
        low = "".join(c.lower() if c.isalpha() else " " for c in text or "")
        padded = f" {' '.join(low.split())} " if low.split() else ""
        out = []
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if (n < 3 and g.strip()) or (n == 3 and g[1] != " "):
                    out.append(sum((0 if c == " " else ord(c)) << 21 * (n - 1 - k) for k, c in enumerate(g)))
        return sorted(out)

    for i, t in enumerate(texts):
        assert sorted(keys[starts[i] : starts[i + 1]].tolist()) == direct(t)


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(60, 8))
    rows = [v.tolist() for v in base] + [(v + rnd.normal(size=8) * s).tolist() for v in base for s in (0.1, 0.3)] + [(2 * base[0]).tolist(), base[1].tolist(), base[1].tolist()]
    rows += [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    data = list(enumerate(rows))
    rnd.shuffle(data)
    df = spark.createDataFrame([(int(i), v, "x") for i, v in data], "vec_id long, embedding array<double>, unit string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert found == brute.vectors(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors.near_vectors(df).collect())
    assert vectors.near_vectors(df.filter("vec_id > 182")).filter("n_links > 0 or not kept").count() == 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_over_many_cells_and_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors.fit_centres, "__defaults__", (200, 40))
    centres = rnd.normal(size=(6, 6))
    data = [(i, (centres[i % 6] + rnd.normal(size=6) * 0.5).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, reach=None).collect()}
    want = brute.vectors(data)
    assert found == want
    # Few cells' planes are near, and still most links are found, and none that is no link.
    some = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    assert all(n <= want[i][0] for i, n in some.items())
    assert sum(some.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_vectors_of_several_dimensions(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [2.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert found == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (0, 5), 6: (0, 6)}


def test_recall_and_pruning_of_cells():
    """Of links at the threshold itself over 0.9 are found, and of the pairs of overlapping clusters about a third is compared."""
    import pyarrow as pa

    rnd = np.random.default_rng(6)
    middle = rnd.normal(size=(400, 64))
    x = (middle[rnd.integers(0, 400, 6000)] + rnd.normal(size=(6000, 64)) * 0.6).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rnd.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1)[:, None]
    every = np.concatenate([x, y])
    centres = vectors.spherical_k_means(every.copy(), len(every) // vectors.CELL)
    unit = pa.array([r.tobytes() for r in every], pa.binary())
    own, row, cell = vectors.placed(unit, centres, vectors.distances(centres), vectors.margin(0.9, 64, vectors.REACH))
    visits = set(zip(row.tolist(), cell.tolist(), strict=True))
    n = len(x)
    met = [own[i] == own[n + i] or (i, own[n + i]) in visits or (n + i, own[i]) in visits for i in range(n)]
    home = np.bincount(own, minlength=len(centres))
    assert np.mean(met) >= 0.9
    assert (home[cell].sum() + (home * home).sum() / 2) / (len(every) ** 2 / 2) < 0.35


@pytest.mark.parametrize(("run", "long"), [(2, 50), (2, None), (3, 20)])
def test_lines_equal_brute_force(docs, texts, run, long):
    import hashlib

    rows = lines.deduplicated(docs, run, long).collect()
    found = {r["doc_id"]: (r["__n_lines"], r["__n_removed"], hashlib.sha256((r["__kept"] or "").encode()).hexdigest()) for r in rows}
    want = brute.lines(enumerate(texts), run, long)
    assert found == want
    assert run == 3 or sum(w[1] for w in want.values()) >= 8


def test_lines_plan_has_no_python(docs, capsys):
    lines.deduplicated(docs).explain("simple")
    mixing.mix_to_weights(docs).explain("simple")
    shown = capsys.readouterr().out
    assert "Exchange" in shown and not any(w in shown for w in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_fingerprints_edits_and_likeness(docs, texts):
    rows = {r["doc_id"]: r for r in minhash.edited_fingerprints(docs).collect()}
    assert {d: r["edited_sha256"] for d, r in rows.items()} == brute.edits(enumerate(texts))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    same = defaultdict(set)
    for d, r in rows.items():
        same[texts[d] or ""].add(r["fingerprint"])
    assert all(len(f) == 1 for f in same.values())

    def grams(t):
        ws = t.encode().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    order = sorted(rows, reverse=True)
    for k, d in enumerate(order):
        a, b = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        for near, other in (("near_edited", edited), ("near_next", b)):
            x, y = grams(a), grams(other)
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(rows[d][near] - true) < 0.17, (d, near)


def test_empty_table_through_every_operator(spark):
    docs = docs_of(spark, ["a"]).limit(0)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    for df in (tokens.token_counts(docs, path), substrings.substring_dedup(docs), suffixes.suffix_dedup(docs), packing.best_fit_packing(docs, queries.tokenizer_file("word_bpe_49k.json")), mixing.mix_to_weights(docs), mixing.mixture(docs), simhash.near_duplicates(docs), lines.deduplicated(docs), minhash.edited_fingerprints(docs)):
        assert df.count() == 0




def test_many_texts_are_looked_up_at_once(monkeypatch):
    path = queries.tokenizer_file("word_bpe_49k.json")
    texts = ["One two, two-three.", None, "", "x" * 70 + " " + "Y" * 70 + " <s> 1.5", "long er " * 40, "One Two " + "y" * 70]
    monkeypatch.setattr(tokens, "LONG_TEXT", 200)
    alone = [tokens.word_ids(t or "", path) for t in texts]
    tokens.worker_state().pop("encoded", None)
    calls, of = [], tokens.Encodings.of
    monkeypatch.setattr(tokens.Encodings, "of", lambda self, pieces: calls.append(len(pieces)) or of(self, pieces))
    assert list(tokens.word_ids_of(texts[:3] + texts[5:], path)) == alone[:3] + alone[5:]
    assert len(calls) == 1
    assert list(tokens.word_ids_of(texts, path)) == alone
    tokens.worker_state().pop("encoded", None)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    assert list(tokens.word_ids_of(texts, path)) == alone


def test_suffixes_hash_a_cut_for_its_keys_once(monkeypatch):
    class Texts:
        def mapInArrow(self, run, schema):
            self.run = run

    text, shape = b"abcdefghij" * 30, repeats.Shape(100, 32)
    doc, at, lo, hi, _ = repeats.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shape)
    batch = pa.RecordBatch.from_pydict({"doc": [0], "text": [text.decode()], "places": [repeats.pack_place(at, lo, hi).tolist()]})
    texts, calls, keys = Texts(), [], repeats.anchor_keys
    for module in (repeats, suffixes):
        monkeypatch.setattr(module, "anchor_keys", lambda cut, shape: calls.append(1) or keys(cut, shape))
    suffixes.sorted_texts(texts, shape)
    assert sum(b.num_rows for b in texts.run(iter([batch]))) > 1 and len(calls) == 1
