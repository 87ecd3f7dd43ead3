"""Quality rules, set joins, mixing, packing, records, scoring and toxicity against plain versions, and on odd rows."""

import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lakequill.llm import common, context_tree, mixing, packing, quality, records, set_join, tokens, toxicity

from .conftest import prose

TOKENIZER = tokens.default_tokenizer()


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def odd(spark, docs):
    """The rows of docs, some twice, some without an id, with more columns whose names clash with an operator's own."""
    more = docs.where("doc_id < 4").union(docs.where("doc_id in (1, 5)").withColumn("doc_id", F.lit(None).cast("long")))
    out = docs.union(more)
    for c in ("n", "fp", "id", "h", "size", "token", "kept", "component_id", "word", "score", "whole", "row"):
        out = out.withColumn(c, F.lit(7))
    return out


# quality


def plain_base(text):
    words = (text or "").replace("\x1c", "\x1c").encode().split()
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base_and_bands(docs, texts):
    z = zstandard.ZstdCompressor(level=3)
    for r in quality.judged(docs).collect():
        text = texts[r.doc_id]
        stats = plain_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.kept and r.base_failed)
        if text:
            assert r.ratio == pytest.approx(len(text.encode()) / len(z.compress(text.encode())))
    verdict = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    noise, same = next(i for i, t in enumerate(texts) if t and t.startswith("same line")), next(i for i, t in enumerate(texts) if t and len(t) == 3000 and " " not in t)
    assert not verdict[noise] and not verdict[same]


def test_quality_filters_rows_whole(spark, docs, nothing):
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    out = quality.passing(odd(spark, docs))
    assert {r.doc_id for r in out.collect()} - {None} == kept and out.columns == odd(spark, docs).columns
    assert quality.passing(nothing).count() == 0 == quality.judged(nothing).count()


def test_bands_reject_repetition_and_noise():
    judge = quality.Judge()
    r = random.Random(1)
    assert not judge(b"the same words again " * 400)[0]
    assert not judge(bytes(r.randrange(33, 126) for _ in range(6000)))[0]
    assert judge(None) == (False, 0.0, 0, 0) and judge(b"")[0] is False


# set join


def plain_classes(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    forest = common.Forest()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                forest.join(a, b)
    return {i: (len(sets[i]), forest.root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den", "bound"), [(3, 9, 10, 10**6), (5, 4, 5, 10**6), (3, 1, 2, 0), (1, 9, 10, 0)])
def test_set_join_is_exact(docs, texts, k, num, den, bound):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.classes(docs, k, num, den, bound).collect()}
    assert got == plain_classes(list(enumerate(texts)), k, num, den)


def test_set_join_over_random_edits(spark):
    """Chains and clusters of near copies at many distances, also such that only pairs across groups link."""
    r = random.Random(8)
    texts = []
    for _ in range(6):
        w = prose(r, r.choice((12, 40, 90, 200)), 3000).split()
        for _ in range(14):
            v = list(w)
            for _ in range(r.randrange(1 + len(v) // 25)):
                v[r.randrange(len(v))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(v))
            if r.random() < 0.4:
                w = v
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for k, num, den in ((3, 9, 10), (5, 4, 5)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in set_join.classes(docs, k, num, den).collect()}
        assert got == plain_classes(list(enumerate(texts)), k, num, den)


def test_set_join_on_odd_rows(spark, docs, nothing):
    plain = {r.doc_id: r.component_id for r in set_join.classes(docs).collect()}
    got = set_join.classes(odd(spark, docs)).collect()
    assert len(got) == odd(spark, docs).count()
    assert all(r.component_id == (None if r.doc_id is None else plain[r.doc_id]) for r in got)
    assert set_join.classes(nothing).count() == 0
    assert sorted(set_join.deduplicated(docs).columns) == sorted(docs.columns)
    stay = {r.doc_id for r in set_join.deduplicated(docs).collect()}
    assert stay == {i for i, (_, c) in plain_classes([(r.doc_id, r.text) for r in docs.collect()], 5, 4, 5).items() if i == c}


def test_components_by_stars_and_in_one_task_agree(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    forest = common.Forest()
    for a, b in links:
        if a != b:
            forest.join(a, b)
    wanted = {x: forest.root(x) for x in forest.up}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for bound in (10**6, 0):
        got = rows_of(common.components(df, bound), "node", "component")
        assert len(got) == len(wanted) and dict(got) == wanted
    assert common.components(df.limit(0)).count() == 0


# mixing


def test_mixing_matches_sql(spark, docs, nothing):
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mixed(docs).collect()}
    c = duckdb.connect()
    documents = docs.toPandas()
    c.register("documents", documents)
    assert got == {r[0]: tuple(r[1:]) for r in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()}
    assert mixing.mixed(nothing).count() == 0


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(4)
    sizes = [(i, "w " * r.randrange(1, 40), r.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(sizes, "doc_id long, text string, source string")
    found = mixing.mixed(docs).toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    for target, part in found.groupby("target"):
        assert 0 <= target - part.taken.sum() <= 40 or target == pytest.approx(part.taken.sum())
    # water-filling: shares by weight, none above twice its source
    per = found.groupby("source_size").target.first()
    assert per.sum() == pytest.approx(1.5 * per.index.to_numpy().sum()) and (per <= 2 * per.index).all()
    again = mixing.mixed(docs.repartition(7)).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mixing_repeats_rows(spark, docs):
    o = odd(spark, docs)
    times = Counter(r.doc_id for r in mixing.repeated(o).collect())
    assert sum(times.values()) == mixing.mixed(o).agg(F.sum("times")).first()[0]
    assert mixing.repeated(o).columns == o.columns


# tokens, packing, records


def exact(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(texts):
    more = ["a  b", "a \n b", "\n\nx", " lead", "trail ", "it's don't", "<|endoftext|> hi", "x\ny z\n", "12 345,67 a1b2", " \n", "日本 語 テ", "no.,!stop...", "a.b c", "\ta", "\n a", "x　 y", "é. É, ß!", "\n", " ", "a\n\tb"]
    r = random.Random(3)
    more += ["".join(r.choice("ab1 .,\n\té'é ") for _ in range(r.randrange(30))) for _ in range(400)]
    encode = tokens.Encoder(TOKENIZER, most=50)
    every = [*texts, *more]
    got = list(encode.batches([None if t is None else t.encode() for t in every], 64))
    assert [g.tolist() for g in got] == [exact(t) for t in every]


def test_packing_places_every_token_once(spark, docs, texts, nothing):
    got = packing.packed(docs, TOKENIZER).collect()
    ids = {i: np.array([*exact(t), tokens.END], dtype="<u4") for i, t in enumerate(texts)}
    for i, whole in ids.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and mine[0].start == 0
        assert sum(r.length for r in mine) == len(whole) and all(a.start + a.length == b.start for a, b in zip(mine, mine[1:]))
        assert all(r.length == 1024 for r in mine[1:]) and (len(mine) == 1) == (len(whole) <= 1024)
        assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in mine)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 1024) + 1
    assert packing.packed(nothing, TOKENIZER).count() == 0
    assert packing.packed(odd(spark, docs), TOKENIZER).groupBy("doc_id").count().count() == len(texts) + 1


def test_sums_of_squares_rule():
    """Each placement has the smallest sum of squares of all that are possible."""
    r = np.random.default_rng(6)
    sizes, room = r.integers(1, 31, 400), 30
    seq, offset = packing.place(sizes, room)
    filled: dict[int, int] = {}
    for size, s, at in zip(sizes.tolist(), seq.tolist(), offset.tolist(), strict=True):
        def cost(into):
            gaps = Counter(room - f for k, f in filled.items() if k != into and f < room)
            f = filled.get(into, 0) + size
            if f < room:
                gaps[room - f] += 1
            return sum(n * n for n in gaps.values())

        options = [k for k, f in filled.items() if f + size <= room] + [-1]
        assert cost(s) == min(map(cost, options))
        assert at == filled.get(s, 0)
        filled[s] = at + size
    many = r.integers(1, 1025, 20_000)
    seq, offset = packing.fitted(many)
    fill = np.bincount(seq, weights=many)
    assert fill.max() <= 1024 and len(fill) <= 1.0005 * (packing.best_fit(-np.sort(-many))[0].max() + 1)
    assert packing.fitted(np.zeros(0, dtype=np.int64))[0].size == 0


def test_records_round_trip(spark, docs, texts, tmp_path, nothing):
    path = str(tmp_path / "r")
    records.write(docs, path, TOKENIZER)
    found = sorted(records.index(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(found, texts, strict=True):
        ids = np.array([*exact(text), tokens.END], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = records.index(spark, path).where("doc_id in (2, 5, 11)").select("file", "offset")
    assert {r.doc_id: r.ids for r in records.fetch(spark, path, some).collect()} == {i: [*exact(texts[i]), tokens.END] for i in (2, 5, 11)}
    records.write(nothing, str(tmp_path / "e"), TOKENIZER)
    assert records.index(spark, str(tmp_path / "e")).count() == 0
    records.write(odd(spark, docs), str(tmp_path / "o"), TOKENIZER)
    assert records.index(spark, str(tmp_path / "o")).count() == odd(spark, docs).count()
    file = next(p for p in (tmp_path / "r" / "data").iterdir() if p.suffix == ".txt" and p.stat().st_size > 500)
    raw = bytearray(file.read_bytes())
    assert len(list(records.frames(bytes(raw)))) > 1
    for at in (3, 9, 200, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.frames(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        list(records.frames(bytes(raw[:-5])))


def test_wide_ids():
    ids = np.array([1, 70_000], dtype="<u4")
    assert records.unpacked(records.packed(None, ids))[0] is None
    assert records.unpacked(records.packed(-5, ids))[1].tolist() == [1, 70_000]


# scoring


def plain_tree(streams, stream, depth):
    """log10 probability of a stream, by context-tree weighting over counts, node by node."""
    counts: dict = {}

    def walk(s):
        padded = b"\n" * depth + s
        for i in range(depth, len(padded)):
            node = 1
            for bit in range(7, -1, -1):
                b = (padded[i] >> bit) & 1
                yield [(node, padded[i - d : i]) for d in range(depth + 1)], b
                node = node * 2 + b

    children: dict = {}
    for s in streams:
        for path, b in walk(s):
            for d, key in enumerate(path):
                counts.setdefault(key, [0, 0])[b] += 1
                if d:
                    children.setdefault(path[d - 1], set()).add(key)

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    memo: dict = {}

    def weighted(key):
        if key not in memo:
            own = kt(*counts[key])
            product = sum(map(weighted, children.get(key, ())))
            memo[key] = own if len(key[1]) == depth else math.log(0.5) + max(own, product) + math.log1p(math.exp(-abs(own - product)))
        return memo[key]

    total = 0.0
    for path, b in walk(stream):
        p = None
        for d in range(depth, -1, -1):
            n = counts.get(path[d], [0, 0])
            own = (n[b] + 0.5) / (sum(n) + 1)
            if d == depth:
                p = own
            else:
                beta = math.exp(min(700, kt(*n) - sum(map(weighted, children.get(path[d], ()))))) if path[d] in counts else 1.0
                p = (beta * own + p) / (beta + 1)
        total += math.log10(p)
    return total


def test_context_tree_is_exact(spark):
    r = random.Random(9)
    texts = [prose(r, n, 40) for n in (5, 30, 60, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = context_tree.fit_tree(docs)
    streams = [context_tree.normal(t.encode())[1] for t in texts]
    look = context_tree.Lookup(tree)
    for s in [*streams, b"quite new\n", b"\n", "é ".encode() + b"\n"]:
        keys, _ = context_tree.events([s])
        assert len(keys) == len(s)
        assert look(keys).sum() == pytest.approx(plain_tree(streams, s, context_tree.DEPTH), rel=1e-5)
    every = (tree.keys[-1][3] >> 8 << 8) | np.arange(256)
    assert (10 ** tree.predict(every)).sum() == pytest.approx(1)
    together, starts = context_tree.events(streams)
    assert np.add.reduceat(look(together), starts) == pytest.approx([look(context_tree.events([s])[0]).sum() for s in streams])


def test_a_bounded_tree_keeps_all_counts_and_sums_to_one(spark, docs):
    counts = docs.select("text").mapInArrow(context_tree._contexts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).cache()
    small = context_tree._bounded(counts, 800)
    assert small.count() < counts.count() and small.agg(F.sum("n")).first() == counts.agg(F.sum("n")).first()
    table = small.toArrow()
    tree = context_tree.Tree(table["key"].to_numpy(), table["n"].to_numpy())
    for context in (int(tree.keys[-1][0]) >> 8, int(tree.keys[-1][-1]) >> 8, 123 << 30):
        assert (10 ** tree.predict((context << 8) | np.arange(256))).sum() == pytest.approx(1)


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_base_scores(docs, texts, frequent):
    got = {r.doc_id: r for r in context_tree.scored(docs, frequent=frequent).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    total, distinct = sum(c.values()) + ends, len(c) + 1
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, total)
        wanted = sum(math.log10((n + 1) / (total + distinct + 1)) for n in [*(c[w] for w in ws), ends])
        assert r.base_score == pytest.approx(wanted) and r.score < 0


def test_scoring_odd_rows(spark, docs, nothing):
    assert context_tree.scored(nothing).count() == 0
    assert context_tree.scored(odd(spark, docs)).count() == odd(spark, docs).count()
    one = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "only held out")], "doc_id long, text string")
    r = context_tree.scored(one).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(8 * 14 * math.log10(0.5), rel=1e-5)


# toxicity


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(12)
    rows, labels = [], []
    hidden = {"w0rthless": 1, "w o r t h l e s s": 1, "worrrrthless": 1, "wor_th_less": 1, "worthless": 1}
    for i in range(500):
        w = prose(r, r.randrange(20, 90), 3000).split()
        toxic = i % 8 == 0
        if toxic:
            w.insert(r.randrange(len(w)), "worthless" if i % 16 else "vequ" + r.choice(["a", "er", "ino"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000 + k, prose(r, 30, 3000) + f" {h} " + prose(r, 9, 3000)) for k, h in enumerate(hidden)]
    rows += [(2000, None), (2001, ""), (None, "worthless"), (2002, "VEQUISSIMO tu")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")


def test_toxic_texts_are_found_however_they_are_written(graded):
    got = {r.doc_id: r for r in toxicity.scored(*graded).collect()}
    assert len(got) == 509
    for i in range(500):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == (i % 8 == 0) and 0 <= got[i].score <= 1
    assert [got[1000 + k].predicted for k in range(5)] == [1] * 5
    assert got[2000].predicted == got[2001].predicted == 0 and got[None].predicted == 1 and got[2002].predicted == 1


def test_labels_of_held_out_rows_teach_nothing(spark, graded):
    docs, labels = graded
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(rows_of(toxicity.scored(docs, x), "doc_id", "score"), key=str) for x in (labels, flipped))
    assert one == two


def test_toxicity_without_labels_and_on_nothing(graded, docs, nothing, spark):
    none = graded[1].limit(0)
    assert toxicity.scored(docs, none).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.scored(nothing, graded[1]).count() == 0
    out = toxicity.without_toxic(odd(spark, docs), *graded)
    assert out.columns == odd(spark, docs).columns and out.count() == odd(spark, docs).count()


def test_no_stretch_is_passed_over():
    r = random.Random(3)
    for _ in range(5000):
        x = "".join(r.choice("ab1@ .-_*\n!xé") for _ in range(r.randint(1, 12)))
        assert not toxicity._STRETCH.search(x) or toxicity.suspicious([x, "", x])[0] and toxicity.suspicious(["q", x])[1]
    assert json.dumps(toxicity.LOOKS)
