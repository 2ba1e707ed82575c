import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from floodlake.llm import bpe, exact_dedup, licenses, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def digests(df):
    ids = bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN)
    return bpe.decode(ids, queries.RANKS).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256))


@pytest.mark.parametrize("which", ["edge", "clashing", "docs"])
def test_bpe_equals_tiktoken(which, request):
    df = request.getfixturevalue(which)
    want = sorted(((r.doc_id, *brute.bpe_row(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert rows(digests(df)) == want


def test_bpe_random_strings_and_round_trip():
    enc, dec = bpe.Encoder(bpe.read_ranks(brute.RANKS), public_tokenizers.PATTERN), bpe.Decoder(bpe.read_ranks(brute.RANKS))
    rnd = random.Random(3)
    tokens = list(bpe.read_ranks(brute.RANKS))
    letters = ["a", "the", " ", "\n", "\t", "é", "漢", "😀", "'s", "12", "###", "\r\n", "\x1c", "\x85", "²", "_", "ation"]
    for _ in range(3000):
        s = "".join(rnd.choice(letters) if rnd.random() < 0.6 else rnd.choice(tokens).decode("utf8", "ignore")
                    for _ in range(rnd.randint(0, 12)))
        assert enc.encode(s) == brute.TIK.encode_ordinary(s)
        assert dec.decode(enc.encode(s)) == s


def test_bpe_long_pieces_tables_that_start_afresh_and_split_runes(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 50)
    enc, dec = bpe.Encoder(bpe.read_ranks(brute.RANKS), public_tokenizers.PATTERN), bpe.Decoder(bpe.read_ranks(brute.RANKS))
    for s in (" " * 9000 + "x", "ab" * 9000, "=" * 10_001, "thereupon" * 2000, "漢" * 5000):
        ids = enc.encode(s)
        assert ids == brute.TIK.encode_ordinary(s)
        text, held = "", b""
        for i in ids:       # one token at a time
            part, held = dec.feed(held, [i])
            assert len(held) <= 3
            text += part
        assert text == s and not held
    assert dec.decode([brute.TIK.encode_ordinary("漢")[0]]).endswith("�")


@pytest.mark.parametrize("which", ["edge", "clashing", "docs"])
def test_license_base_phrases(which, request):
    df = request.getfixturevalue(which)
    got = rows(licenses.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = sorted(((r.doc_id, *brute.license_row(r.text, licenses.BASE_PHRASES)) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_license_spans_survive_an_inserted_and_a_lost_word(spark):
    mit = next(p for n, p in licenses.TEMPLATES if n == "mit" and p.startswith("permission")).split()
    texts = ["x " + " ".join(mit), " ".join(mit[:9] + ["quite"] + mit[9:]), " ".join(mit[:7] + mit[8:]), " ".join(mit[:8]),
             "a copy of this and the license of any person", "Released under the\nMIT license.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[k].labels for k in range(7)] == ["mit", "mit", "mit", "", "", "mit", ""]
    assert got[0].score == 1.0 and 0.75 <= got[2].score < 1 and got[3].score == 0.0
    assert got[0].spans[0]["first"] == 1 and got[0].spans[0]["words"] == len(mit)


def test_license_relatives_get_their_own_label_only(spark):
    """Every template's own words, and versions and kinds that no template has."""
    texts = [(n, p) for n, p in licenses.TEMPLATES]
    texts += [("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."), ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"), ("cc-by-4.0", "Licensed under CC BY 4.0!"),
              ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"), ("", "licensed under cc by 3.0"), ("", "licensed under cc by nc xy 4 0"),
              ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
              ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
              ("", "this work is licensed under the gnu general public license version 2"), ("", "licensed under the apache license version 1 1"),
              ("cc-by-4.0,mit", "Licensed under CC BY 4.0. Released under the MIT License."),
              ("cc-by-4.0,cc-by-nc-4.0", "licensed under cc by nc 4 0 or else licensed under cc by 4 0")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    base = {label for label, _ in licenses.BASE_PHRASES}
    for k, (want, text) in enumerate(texts):
        assert {x for x in got[k].labels.split(",") if x} - base == {x for x in want.split(",") if x}, text
        assert {x for x in got[k].base_labels.split(",") if x} <= set(got[k].labels.split(","))


@pytest.mark.parametrize("which", ["edge", "clashing", "docs", "noise"])
def test_license_labels_equal_brute_force(spark, which, request):
    if which == "noise":
        rnd = random.Random(12)
        pool = [w for _, p in (*licenses.TEMPLATES, *licenses.BASE_PHRASES) for w in p.split()]
        def text():
            out = []
            for _ in range(rnd.randint(1, 5)):
                words = rnd.choice(licenses.TEMPLATES)[1].split()
                for _ in range(rnd.choice([0, 0, 1, 2])):
                    k = rnd.randrange(len(words))
                    words[k:k + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(pool)]])
                out += [*words, *[rnd.choice(pool) for _ in range(rnd.choice([0, 0, 1, 9]))]]
            return " ".join(out)
        df = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    got = rows(licenses.scan_licenses(df).select("doc_id", "labels"))
    assert got == sorted(((r.doc_id, brute.license_labels(r.text, licenses)) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("which", ["edge", "clashing", "docs"])
def test_quality_counts(which, request):
    df = request.getfixturevalue(which)
    got = rows(quality_rules.judge_quality(df).select("row.doc_id", *quality_rules.STATS, "base_failed"))
    want = sorted(((r.doc_id, *brute.quality_row(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_hosts_that_fail_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows_ = [(f"bad{i % 2}", "few words") for i in range(200)] + [(f"ok{i % 9}", good) for i in range(900)]
    rows_ += [("bad0", good), (None, good)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows_)], "doc_id long, source string, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(df).select("row.doc_id", "kept").collect()}
    assert not kept[1100] and kept[1101] and all(kept[i] for i in range(200, 1100))


def test_rates_of_small_hosts_are_shrunk(spark):
    rows_ = [(f"h{i % 10}", i // 10 % 10 < 1 + i % 10 % 3) for i in range(1000)] + [("tiny", True), ("none", False)]
    df = spark.createDataFrame(rows_, "host string, base_failed boolean")
    got = {r.host: r for r in quality_rules.host_verdicts(df).collect()}
    n, mean = 1002, (sum(f for _, f in rows_)) / 1002
    ss = sum((sum(f for h, f in rows_ if h == x)) ** 2 / sum(1 for h, _ in rows_ if h == x) for x in got)
    v = ss / n - mean ** 2 - mean * (1 - mean) * len(got) / n
    k = mean * (1 - mean) / v - 1
    assert k > 1
    assert got["tiny"].host_rate == pytest.approx((1 + k * mean) / (1 + k)) and got["tiny"].host_ok
    assert got["h0"].host_rate == pytest.approx((10 + k * mean) / (100 + k))


@pytest.mark.parametrize("which", ["edge", "clashing", "docs"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    got = rows(exact_dedup.dedup(df).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))))
    assert got == sorted(brute.dedup_rows([tuple(r) for r in df.select("doc_id", "text").collect()]), key=str)


def test_dedup_state_goes_on_over_batches(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    batches = [[(5, "a b"), (6, "c")], [(1, "ab"), (2, "a  b"), (7, "d")]]
    schema = None
    for k, batch in enumerate(batches):
        landed = exact_dedup.with_digest(spark.createDataFrame(batch, "doc_id long, text string"))
        schema = landed.schema
        landed.coalesce(1).write.mode("append").parquet(feed)
        exact_dedup.feed_state(spark.readStream.schema(schema).parquet(feed), state)
    exact_dedup.feed_state(spark.readStream.schema(schema).parquet(feed), state)    # nothing new: no change
    got = {(r.keep_id, r.group_size) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {(2, 3), (6, 1), (7, 1)}


def test_dedup_keeps_one_row_of_shared_missing_and_odd_ids(spark):
    least = -(1 << 63)
    cases = [[(5, "a b"), (5, "ab"), (6, "ab")], [(None, "x"), (None, " x")], [(3, "y"), (3, "y"), (None, "y")], [(least, "z"), (4, "z")],
             [(7, "p q"), (7, "pq "), (None, "pq")]]
    df = spark.createDataFrame([r for c in cases for r in c], "doc_id long, text string")
    got = rows(exact_dedup.dedup(df).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))))
    assert got == sorted(brute.dedup_rows([tuple(r) for r in df.collect()]), key=str)
    assert sum(r[3] for r in got) == len(cases)
    words = spark.createDataFrame([("b", "t t"), ("a", "t t"), (None, "tt"), ("a", "u")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(words).collect()}
    assert got == {("a", "a", 3, True), ("b", "a", 3, False), (None, "a", 3, False), ("a", "a", 1, True)}


def test_dedup_splits_a_digest_that_two_texts_share(spark, monkeypatch):
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, " a"), (4, "c"), (4, "c")], "doc_id long, text string")
    got = rows(exact_dedup.dedup(df).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == sorted([(1, 3, 2, False), (3, 3, 2, True), (2, 2, 1, True), (4, 4, 2, True), (4, 4, 2, False)], key=str)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 0, 1])
@pytest.mark.parametrize("which", ["edge", "docs"])
def test_simhash(which, crowd, request):
    df = request.getfixturevalue(which)
    all_ = [tuple(r) for r in df.select("doc_id", "text").collect()]
    fps = {d: brute.fingerprint(t) for d, t in all_ if d is not None}
    want = brute.classes(fps)
    got = simhash.near_duplicates(df, crowd=crowd).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(all_)
    assert {(r.doc_id, r.f, r.component_id) for r in got if r.doc_id is not None} == {(d, f"{f:016x}", want[d]) for d, f in fps.items()}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 0, 2])
def test_simhash_links_of_dense_fingerprints(spark, crowd):
    rnd = random.Random(11)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
        fps |= {centre ^ 3, centre ^ (1 << 63) ^ (1 << 42), centre ^ (3 << 21)}
    fps = sorted(fps)
    named = dict(enumerate(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_pairs(df, crowd).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    num = {f: k for k, f in named.items()}
    roots = {r.node: r.root for r in simhash.components(
        spark.createDataFrame([(num[a], num[b]) for a, b in links], "a long, b long")).collect()}
    want = brute.classes(named)
    assert {k: roots.get(k, k) for k in named} == want


def numbers_as_fingerprints(docs, ident="doc_id", text="text", k=0, seed=0, carry=()):
    return docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("long").alias("fp"), *carry)


def test_simhash_classes_are_those_of_the_fingerprints_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", numbers_as_fingerprints)
    far = 0xFFFF << 24
    # a chain through a null id; a class of null ids; two apart that share an id, also where one has a smaller id
    rows = [(7, 0), (None, 3), (9, 15), (None, far), (None, far ^ 1), (5, far << 8), (5, 0xFFFFF), (6, 0xFFFFF ^ 4), (9, 0x5555555555), (None, far)]
    df = spark.createDataFrame([(d, str(fp)) for d, fp in rows], "doc_id long, text string")
    got = simhash.near_duplicates(df).select("doc_id", "fp", "root_fp", "component_id").collect()
    root = {0: 0, 3: 0, 15: 0, far: far, far ^ 1: far, 0xFFFFF ^ 4: 0xFFFFF ^ 4, 0xFFFFF: 0xFFFFF ^ 4}
    name = {0: 7, far: None, far << 8: 5, 0xFFFFF ^ 4: 5, 0x5555555555: 9}
    want = [(d, fp, root.get(fp, fp), name[root.get(fp, fp)]) for d, fp in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_near_stage_keeps_one_row_of_every_class_whatever_the_ids(spark, monkeypatch):
    import corpus_pipeline
    texts = [" ".join(f"{w}{i} {w}{i * i + 1} {w}{i + 3}" for i in range(60)) for w in "xy"]
    df = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string")
    assert {r.text for r in corpus_pipeline.near(spark, df, SF).collect()} == set(texts)
    monkeypatch.setattr(simhash, "fingerprints", numbers_as_fingerprints)
    df = spark.createDataFrame([(None, str(0)), (None, str(3)), (None, str(15)), (None, str(0xFFFF << 24))], "doc_id long, text string")
    left = {int(r.text) for r in corpus_pipeline.near(spark, df, SF).collect()}
    assert len(left) == 2 and 0xFFFF << 24 in left


def test_components_of_chains_and_ties(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 101), (200, 200), (7, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


@pytest.mark.parametrize("op", [
    lambda d: digests(d), licenses.scan_licenses, quality_rules.judge_quality, exact_dedup.dedup, simhash.near_duplicates])
def test_empty_tables(op, none):
    assert op(none).count() == 0


def test_bpe_round_trip_in_one_worker_equals_encode_then_decode(spark, monkeypatch):
    long_text = "Ein langer Text, 12 words & more. " * 9000     # beyond LONG_TEXT
    assert len(long_text) > bpe.LONG_TEXT
    rows = [(1, "a", long_text), (2, None, None), (3, "c", ""), (3, "c", ""), (4, "d", "xé\U0001f600 中")]
    df = spark.createDataFrame(rows, "doc_id long, decoded_by string, text string")
    keep = ("doc_id", "decoded_by")
    apart = bpe.decode(bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN, keep=keep), queries.RANKS)
    at_once = bpe.round_trip(df, queries.RANKS, public_tokenizers.PATTERN, keep=keep)
    assert at_once.columns == apart.columns and at_once.schema == apart.schema
    got = sorted(map(tuple, at_once.collect()), key=str)
    assert got == sorted(map(tuple, apart.collect()), key=str)
    assert {r[0]: r[3] for r in got} == {i: t or "" for i, _, t in rows}
    enc = bpe.Encoder(bpe.read_ranks(brute.RANKS), public_tokenizers.PATTERN)
    whole = enc.encode_bytes(long_text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1 << 30)
    assert enc.encode_bytes(long_text) == whole
    assert bpe.round_trip(df.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0
