"""Text operators against plain evaluations: given rows, and hand-made nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from appfacts.llm import chroma, decontaminate, html_text, jaccard_trie, licenses, packing, pieces, suffix_dedup, toxicity, url_rules
from appfacts.llm.bytehash import ALNUM_WORD, word_hashes
from appfacts.llm.graph import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = "word " * 300_000 + "all rights reserved"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# -- licenses ---------------------------------------------------------------------------------------------------


def license_result(df):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    return sorted((tuple(r) for r in licenses.scan_licenses(df).select(cols).collect()), key=repr)


def test_licenses_given(docs):
    assert license_result(docs) == sorted(brute.license_rows(pairs(docs)), key=repr)


def test_licenses_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "CC BY cc-by\ncc by"), (4, "All rights, reserved! all rights all rights reserved"),
        (5, "general public"), (6, LONG), (None, "cc by"), (7, "é general PUBLIC license ccby"), (8, "cc"),
    ]
    df = table(spark, rows)
    assert license_result(df) == sorted(brute.license_rows(rows), key=repr)
    assert license_result(df.unionByName(df)) == license_result(df)  # repeated rows count once
    assert license_result(table(spark, [])) == []


def test_licenses_near_wording(spark):
    text = licenses.TEMPLATES[2][1].split()
    text[9:9] = ["quite", "clearly"]
    found = licenses.scan_licenses(table(spark, [(1, "x y " + " ".join(text)), (2, " ".join(text[:8]))])).collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].labels == "apache" and 0.7 <= by_id[1].score < 1
    assert by_id[2].labels == "" and by_id[2].score == 0


def test_licenses_with_stray_words_nearby(spark):
    """A full match counts though words of the template come again close to it."""
    rows = [(1, "Released under the MIT License."), (2, "Released under the MIT License. The MIT License applies."), (3, "the MIT, the MIT")]
    clashing = table(spark, rows).withColumns({c: F.lit(1) for c in ("label", "gram", "key", "pos")})
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(clashing).collect()}
    assert got == {1: ("mit", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}


# -- URLs -------------------------------------------------------------------------------------------------------


def test_urls_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://example.com/en/1?q=/en/",
        "http://www.example.com/en/", "http://xwww.example.com/en/", "http://notexample.com/en/", "https://a.net/es/1#x",
        "https://a.net/es", "https://a.net?x/es/", "http://casino-win.org/", "http://a.org/casinos", "http://a.org/p?casino",
        "http://Ä.net/fr/\nx", "http://example.com/en/1?q=/en/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, url_rules.BASE_RULES, url_rules.WORD_RULES, keep=["page_id"]).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host = rest
        for mark in "/?#":
            host = host.partition(mark)[0]
        host = host.translate(brute.LOWER)
        path = rest.partition("#")[0].partition("?")[0]
        path = path[path.index("/") :] if "/" in path else ""
        fits = [
            (len(rule), rule, verdict)
            for verdict, rule in url_rules.BASE_RULES
            for h, p in [(rule[: rule.index("/")], rule[rule.index("/") :])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1]), url
        if best[1]:
            assert got[i].verdict == best[2]
    assert got[14].verdict == "block" and got[15].verdict == "allow" and got[16].verdict == "allow"


def test_urls_without_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = url_rules.judge_urls(pages, url_rules.BASE_RULES, url_rules.WORD_RULES, keep=["page_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "html" not in plan.split("Physical Plan")[1].split("ReadSchema")[1][:80]


# -- pieces -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ODD = [
    "", "a", " a", "  a  b ", "▁x▁", "\x00\x01", "é́ \U0001f600 日本語\n\n x", "<s> </s> <unk> <0x41>", "�﻿", "a\tb\r\n", "   ",
    " ▁ x", "ab" * 3000, "1234 56", None,
]


def test_pieces_equal_the_library(spark, docs, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = pairs(docs) + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = table(spark, rows)
    digests = {r.doc_id: tuple(r)[1:] for r in pieces.digest_documents(df, model).collect()}
    full = {r.doc_id: r for r in pieces.encode_documents(df, model).collect()}
    for doc, text in rows:
        ids = sp.encode(text or "")
        plain = sp.decode(ids)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), plain)]
        assert digests[doc] == (len(ids), *sha)
        r = full[doc]
        assert r.ids == ids and r.decoded == plain
        data = (text or "").encode()
        assert all(a <= b for a, b in zip(r.begins, r.ends, strict=True)) and r.begins == sorted(r.begins)
        # Spans of whole pieces spell the text.
        if ids:
            assert r.begins[0] == 0 and r.ends[-1] == len(data)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("spaces", [True, False])
def test_normalizing_through_the_map(model, rule, spaces):
    """A model with a character map: text and alignment as the library's normalizer gives them."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    source = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=spaces)
    proto, spec = pb.ModelProto(), pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    spec.ParseFromString(source.serialized_model_proto())
    proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    codec = pieces.Codec(proto.SerializeToString())
    for text in ["", "ｱｲｳ ①②", "  Ａ  b　c ", "ﬁne ½ ㌔", "é x\t\ny", "İI ß", "   ", "a​b", "한글 ㈱"]:
        normal = codec.normalize(text)
        assert normal.text == source.normalize(text), (rule, text)
        assert len(normal.source) == len(normal.text.encode()) + 1 and list(normal.source) == sorted(normal.source)
        ids, begins, ends = codec.encode(text)
        assert len(ids) == len(begins) == len(ends)
        spans = sorted(set(zip(begins, ends, strict=True)))
        text.encode()[: ends[-1] if ends else 0].decode()  # ends on a character
        assert all(a <= b for a, b in spans)


def test_alignment_of_plain_models(model):
    """Where only spaces change, sources and text are those of replacing one character at a time."""
    codec = pieces.codec(model)
    assert codec.map is None and not codec.one_space
    for text in [t for t in ODD if t] + [" ", "ü 日 \U0001f600  ▁"]:
        fast, slow = codec.normalize(text), codec._stepwise(text.encode())
        assert fast.text == slow.text and list(fast.source) == list(slow.source), text
        assert codec.encode(text)[2][-1] == len(text.encode())


def test_digests_come_from_checked_spans(model, monkeypatch):
    """A text whose alignment or pieces are wrong fails where digests are made."""
    made = {}
    monkeypatch.setattr(pieces, "map_batches", lambda df, fn, schema: made.setdefault("run", fn))
    pieces.digest_documents(types.SimpleNamespace(select=lambda *c: None), model)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    assert made["run"](batch).column("n_tokens").to_pylist() == [len(pieces.codec(model).encode("some words")[0])]
    normalize = pieces.Codec.normalize
    short = lambda c, text: pieces.Normalized((n := normalize(c, text)).text, n.source[:-1])
    other = lambda c, text: pieces.Normalized(normalize(c, text).text, np.arange(len(normalize(c, text).source))[::-1])
    for wrong in (short, other):
        monkeypatch.setattr(pieces.Codec, "normalize", wrong)
        with pytest.raises(ValueError, match="cover"):
            made["run"](batch)


def test_decoding_broken_bytes(model):
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=model), pieces.codec(model)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        ids = [i for i in ids if i not in (0,)]
        assert codec.decode(ids) == sp.decode(ids), ids


# -- packing ----------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = pairs(docs) + [(900, None), (901, ""), (902, "x " * 5000)]
    packed = packing.pack_documents(table(spark, rows), path, pattern, size=256, block_ids=20_000).cache()
    encode = packing.byte_bpe(path, pattern)
    got = {}
    for r in packing.unpack(packed).collect():
        got.setdefault(r.doc_id, {})[r.at] = list(r.ids)
    for doc, text in rows:
        assert [i for at in sorted(got[doc]) for i in got[doc][at]] == [*encode(text or "").tolist(), 50256]
    for m in packed.collect():
        ids = np.frombuffer(m.ids, "<u4")
        assert len(ids) == m.n_rows * 256 and m.cu_seqlens[0] == 0 and m.row_starts[-1] == len(m.doc_ids) == len(m.position_resets)
        for a, n in zip(m.position_resets, np.diff(m.cu_seqlens), strict=True):
            assert a // 256 == (a + n - 1) // 256  # no segment crosses rows
    assert packing.packing_report(packed, 256).first().padding < 0.05
    assert packing.pack_documents(table(spark, []), path, pattern).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for size in (1, 7, 64, 100):
        lengths = rng.integers(1, size + 1, 200)
        rows = packing.best_fit(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(200))
        room = []
        for item in np.argsort(-lengths, kind="stable"):  # the same rule by plain search
            fits = [r for r in room if r >= lengths[item]]
            room.remove(min(fits)) if fits else None
            room.append((min(fits) if fits else size) - lengths[item])
        assert sorted(room) == sorted(size - lengths[r].sum() for r in rows)


# -- repeated bytes ---------------------------------------------------------------------------------------------


def repeat_result(df, length):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest_repeats(df, length).collect()}


@pytest.mark.parametrize("length", [100, 33])
def test_repeats_given(docs, length):
    assert repeat_result(docs, length) == {d: v[:4] for d, v in brute.repeats(pairs(docs), length).items()}


def test_repeats_cases(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh é") for _ in range(500))
    rows = [(1, "a" * 1000), (2, "a" * 150), (3, None), (4, ""), (5, "ab" * 300), (6, "xyz" + "ab" * 60), (7, "é" * 200), (8, "q" + "é" * 120)]
    rows += [(10 + i, base[i * 7 : i * 7 + 300] + "-" * i + base[: 90 + i]) for i in range(20)]
    df = table(spark, rows)
    want = brute.repeats(rows, 100)
    assert repeat_result(df, 100) == {d: v[:4] for d, v in want.items()}
    assert repeat_result(df.unionByName(df).distinct(), 100) == {d: v[:4] for d, v in want.items()}
    twice = suffix_dedup.digest_repeats(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(rows) and {(r.doc_id, r.n_removed) for r in twice} == {(d, v[1]) for d, v in want.items()}
    kept = suffix_dedup.remove_repeats(df.withColumn("kept", F.lit(1)).withColumn("note", F.lit("n")), as_text=True)
    assert {r.doc_id: r.kept for r in kept.collect()} == {d: v[4] for d, v in want.items()} and "note" in kept.columns
    assert suffix_dedup.digest_repeats(table(spark, [])).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    """Chunk borders change nothing."""
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    whole = suffix_dedup.find_blocks([text], 100)
    windows = lambda b: {(p >> 16) + i: (int(g), (p >> 16) + (p & 0xFF)) for p, g in zip(b[1].tolist(), b[2], strict=True) for i in range(p >> 8 & 0xFF)}
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 333)
    cut = suffix_dedup.find_blocks([text], 100)
    assert windows(whole) == windows(cut) and len(windows(cut)) == 4901


# -- similarity join --------------------------------------------------------------------------------------------


def jaccard_result(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_trie.jaccard_components(df, **more).collect()}


def test_jaccard_given(docs):
    assert jaccard_result(docs) == brute.jaccard(pairs(docs))


@pytest.mark.parametrize("block", [400, 300_000])
def test_jaccard_cases(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 20, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w[: rng.randint(1, len(w))] if rng.random() < 0.2 else w)))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "A b"), (404, "a B"), (405, "é É"), (406, "é É")]
    df = table(spark, rows).withColumn("key", F.lit("k")).withColumn("n", F.lit(0))
    assert jaccard_result(df, block_grams=block) == brute.jaccard(rows)
    kept = {r.doc_id for r in jaccard_trie.first_of_groups(df).collect()}
    assert kept == {d for d, (_, c) in brute.jaccard(rows).items() if c == d}


def test_jaccard_empty(spark):
    assert jaccard_result(table(spark, [])) == {}


def test_trie_overlaps():
    """Every pair over the threshold is found by a walk, none below."""
    rng = random.Random(8)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.int64) for _ in range(150)]
    trie = jaccard_trie.Trie()
    for i, s in enumerate(sets):
        want = {j for j in range(i) if 100 * len(np.intersect1d(s, sets[j])) >= 80 * len(np.union1d(s, sets[j]))}
        assert set(trie.partners(s, len(s), 80, lambda _: False)) == want
        trie.add(s, len(s), (i, len(s)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# -- decontamination --------------------------------------------------------------------------------------------


def leaks(docs, items):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(docs, items).collect()}


def test_leaks_cases(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([14, 20, 20, 35, 59]))) for i in range(15)]
    items += [(20, items[0][1][:10] + text(10)), (21, ["just", "three", "words"]), (22, [])]
    rows = []
    for i in range(120):
        passage = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1])):
            if passage:
                passage[rng.choice([0, -1])] = "changed"
        rows.append((i, " ".join(text(rng.randrange(60)) + passage + text(rng.randrange(60)))))
    rows += [(200, None), (201, ""), (202, "Just, THREE words!")]
    named = [(i, " ".join(w)) for i, w in items] + [(23, None)]
    df = spark.createDataFrame(named, "item_id bigint, text string")
    want = {k: round(v, 9) for k, v in brute.item_windows(rows, named).items()}
    got = leaks(table(spark, rows), df)
    assert got == want and len(want) > 80
    clean = {r.doc_id for r in decontaminate.drop_leaks(table(spark, rows), df).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}
    assert leaks(table(spark, rows), df.where("false")) == {} and leaks(table(spark, []), df) == {}


def test_leaks_in_texts_shorter_than_the_item(spark):
    """A whole text that lacks words of an item is compared with it, at the ends of the batch and between other texts."""
    long, short = [f"l{i}" for i in range(59)], [f"s{i}" for i in range(16)]
    named = [(1, " ".join(long)), (2, " ".join(short)), (3, "two words")]
    rows = [(i, " ".join(w)) for i, w in enumerate([
        short[:-1], ["x", "y"], long[:29] + long[30:], long[:40], short[:-3], short[1:], ["two"], long[4:], [], long[:-1] + ["z"], short[2:15]
    ])]
    want = {k: round(v, 9) for k, v in brute.item_windows(rows, named).items()}
    assert leaks(table(spark, rows), table(spark, named).toDF("item_id", "text")) == want
    assert {(0, 2), (2, 1), (5, 2), (7, 1)} <= want.keys() and want[0, 2] == round(11 / 12, 9) and want[2, 1] == round(50 / 59, 9)


def test_leaks_of_repeated_and_templated_items(spark):
    """One changed word is found under every id of a repeated item, and in passages that many items share."""
    item, shared = [f"l{i}" for i in range(59)], [f"s{i}" for i in range(40)]
    named = [(i, " ".join(item)) for i in range(3)] + [(10 + i, " ".join([*shared, *[f"e{i}x{j}" for j in range(4)]])) for i in range(10)]
    rows = [(1, " ".join([*item[:29], "changed", *item[30:]])), (2, " ".join([*shared[:-1], "other", *[f"e4x{j}" for j in range(4)]]))]
    rows += [(3, " ".join([*shared, "none", "of", "these", "words"])), (4, " ".join(["new", *shared[1:], *[f"e2x{j}" for j in range(4)]]))]
    want = {k: round(v, 9) for k, v in brute.item_windows(rows, named).items()}
    assert leaks(table(spark, rows), table(spark, named).toDF("item_id", "text")) == want
    assert {(1, 0), (1, 1), (1, 2), (4, 12), *[(3, 10 + i) for i in range(10)]} <= want.keys()


def test_prefixes_meet():
    """Sets over the threshold in either measure share a shingle of their prefixes."""
    rng, close = random.Random(9), 0
    weight = {g: 1 / rng.choice([1, 1, 2, 3, 10]) for g in range(60)}
    for _ in range(3000):
        a = [rng.randrange(60) for _ in range(rng.randint(1, 30))]
        b = [rng.randrange(60) if rng.random() < 0.08 else g for g in a][: max(1, len(a) - rng.randrange(3))]
        wa, wb = [weight[g] for g in a], [weight[g] for g in b]
        if decontaminate.similarity(*map(np.array, (a, wa, b, wb))) >= decontaminate.SIMILAR:
            close += 1
            assert set(decontaminate._prefix(a, wa)) & set(decontaminate._prefix(b, wb))
    assert close > 500


def test_leaks_in_parts(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = leaks(docs, items)
    monkeypatch.setattr(decontaminate, "PART_SHINGLES", 300)
    assert leaks(docs, items) == whole and whole


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(9)
    a = [rng.getrandbits(63) for _ in range(20)]
    b = [x ^ sum(1 << i for i in rng.sample(range(63), decontaminate.RADIUS)) for x in a]
    frame = lambda xs, n: spark.createDataFrame(list(enumerate(xs)), f"{n} bigint, print bigint")
    left = decontaminate.blocks(frame(a, "i"), 0).drop("print")
    right = decontaminate.blocks(frame(b, "j"), decontaminate.RADIUS // decontaminate.BLOCKS).drop("print")
    met = {(r.i, r.j) for r in left.join(right, ["block", "value"]).select("i", "j").collect()}
    assert {(i, i) for i in range(20)} <= met


# -- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    """Recall in every language and clean rows flagged, on rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    share = scored.join(labels, "doc_id").groupBy("lang", "toxic").agg(F.avg("predicted").alias("p")).collect()
    assert all(r.p >= 0.8 if r.toxic else r.p < 0.02 for r in share) and len(share) == 8


def test_stems_against_plain_counting(spark):
    """Learned entries and their hits, counted with strings; copies of one text count once."""
    rows = [(f"der tag war {'schlimm' + e} und {'schlimm' + e[::-1]} {i} x", 1.0) for i, e in enumerate("ab cd ef gh ij kl mn op".split())]
    rows += [(f"der tag war schlimm {i} y", 0.0) for i in range(6)] + [(f"ein schöner tag und {i} z{i}", 0.0) for i in range(40)]
    rows += [("only copies say wretch wretch here", 1.0)] * 50
    entries = toxicity.learn_stems(spark.createDataFrame(rows, "text string, toxic double"))
    for need in (1, 2):
        assert all(w > 0 for _, n, w in entries if n == need)
    lexicon = toxicity.Lexicon(entries)
    texts = ["schlimmer und schlimmste", "schlimmer", None, "", "wretch wretch", "schlimm" * 2 + " schlimmes " + "x" * 3_000_000 + " schlimm"]
    words, at = word_hashes(texts, ALNUM_WORD)
    taught, odds = lexicon.hits(texts, len(words))
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    assert [int(taught[of == i].sum()) for i in range(len(texts))] == [2, 0, 0, 0, 0, 3]
    assert [o > 0 for o in odds] == [True, False, False, False, False, True]


def test_text_features(spark):
    """Each feature against counting by hand."""
    empty = toxicity.Lexicon([])
    seeds, second = (toxicity._hashed(w) for w in (toxicity.INSULTS, toxicity.SECOND_PERSON))
    text = "You IDIOT, you 1d10t!! Why? ok 42"
    row = dict(zip(toxicity.NAMES, toxicity.text_features([text], seeds, empty, second)[0], strict=True))
    n = len(text)
    want = {
        "seed_density": 1 / 7, "seed_count": math.log(2), "learned_density": 0, "learned_count": 0, "learned_odds": 0,
        "near_second_person": math.exp(-1 / 5) / 7, "second_person": 2 / 7, "capitals": 7 / 18, "digits": 5 / n,
        "punctuation": 4 / n, "exclamation": 2 / n, "question": 1 / n, "punctuation_runs": 1 / n, "obfuscated": 1 / 7,
        "words": math.log(8), "word_size": 23 / 7,
    }
    assert row == pytest.approx(want)
    assert toxicity.text_features([None], seeds, empty, second).tolist() == toxicity.text_features([""], seeds, empty, second).tolist()


def test_toxicity_cases(spark):
    rows = [(i, "you are an idiot and a clown" if i % 3 == 0 else "a quiet day by the sea") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "You 1d10t, you stup1d clown!!!"), (None, "fine words"), (103, "fine " * 200_000)]
    docs = table(spark, rows).withColumn("score", F.lit(5)).withColumn("features", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].predicted == 1 and got[1].predicted == 0 and got[102].predicted == 1 and got[101].predicted == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}
    none = toxicity.score_documents(docs, labels.where("false")).where("doc_id = 0 or doc_id = 1").collect()
    assert {r.doc_id: r.predicted for r in none} == {0: 1, 1: 0}
    assert toxicity.score_documents(table(spark, []), labels).count() == 0


# -- pages ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<title>x</title><p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<table><tr><th>Name<th>Value<tr><td>long name<td>1</table>", "Name       Value\nlong name  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("a<div hidden>no</div><p style='display:none'>no</p><span style='visibility:hidden'>n</span>b", "ab"),
        ("1 < 2 &amp; &lt;b&gt; <!-- no --><script>if (a<b) '</p>'</script>x", "1 < 2 & <b> x"),
        ("a<br>b<br><br>c<hr>d", "a\nb\n\nc\n\n---\n\nd"),
        ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"),
        ("<p>a</i></div></p>b</p>c", "a\n\nb\n\nc"),
        ("<b>un<p>closed", "un\n\nclosed"),
        ("<img alt='pic' src=x><input value=v><select><option>o</select>y", "pic o y"),
        ("<a href=\"x>y\">l</a> <", "l <"),
        ("<div>" * 3000 + "deep", "deep"),
        ("", ""),
    ],
)
def test_page_layout(page, text):
    assert html_text.page_text(page).strip("\n") == text.strip("\n") or html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
        ("<table><form><tr><td>A<tr><td>B</form></table>", "A\nB"),
        ("<table><tr>text<td>A</table>", "text\nA"),
        ("<table><tbody>s<p>t</p><tr><td>x</td></tr></tbody></table>", "s\n\nt\n\nx"),
        ("<table><tr><td>A<td><table><tr><td>in</table><tr hidden><td>n</tr><tr><td>B</table>", "A  in\nB"),
        ("<table><colgroup><col><td>A</table>", "A"),
        ("a <textarea>b &amp; <i>c</textarea>d", "a b & <i>cd"),
        ("<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math> y", "x y"),
        ("<select><optgroup label=g><option>a<option selected>b</select>", "g a b"),
        ("<span aria-hidden=true>a</span>b", "ab"),
        ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no", "yes"),
        ("<table><tr style='visibility:hidden'><td>no<td style='visibility: visible'>a<tr><td>b</table>", "   a\nb"),
        ("<table style='visibility:collapse'><caption>no</caption><tr><td>no</table>x", "x"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>a</text></svg>", "a"),
        ("<input type=submit value='Go on'><input type=reset><input type=text value=no><input value=no>", "Go on Reset"),
        ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<details>no</details><dialog>no</dialog><dialog open>d</dialog>", "d"),
        ("<style>/* .a{} */ .h, #i {display:none} p.v{visibility:hidden} b{display:none}</style><i class='x h'>n</i><i id=i>n</i>"
         "<p class=v>n<b style='display:inline'>n</b></p><p>y<b>n</b>", "y"),
        ("<style>@media print {.h{display:none}} div .d{display:none} .e{display:none} p.e{display:block}</style>"
         "<i class=h>a</i><div><i class=d>b</i></div><p class=e>c<i class=e>n", "a\nb\n\nc"),
        ("<style>.h{display:none", ""),
    ],
)
def test_all_visible_text_is_kept(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("tag", ["div", "b", "blockquote", "ul><li", "table><tr><td", "form", "p><b"])
def test_any_depth(tag):
    """What is deep is laid out as what is not: hidden parts stay hidden, tables keep their columns."""
    deep = f"<{tag}>" * 3000 + "<p style='display:none'>no</p><table><tr><td>aa<td>b<tr><td>c<td>d</table>"
    lines = [x.strip() for x in html_text.page_text(deep).split("\n") if x.strip(" -")]
    assert [x.lstrip("- ") for x in lines] == ["aa  b", "c   d"]


def test_pages(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "<p>x", 0), (3, "<p>x", 0), (4, "<td>" * 50_000, 0)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, html string, text int"))
    assert sorted((r.page_id, r.text[:1], r.n_lines) for r in got.collect()) == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (4, "", 0)]
    given = html_text.extract_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    assert given.where(F.col("text").rlike("<[a-z/]|track\\(|margin:0")).count() == 0 and given.where("n_chars > 100").count() > 40


# -- recordings -------------------------------------------------------------------------------------------------


def test_recordings_align(spark):
    """Noisy and shifted copies are found: recall against brute force over all query pairs."""
    rng = np.random.default_rng(11)
    tunes = [np.frombuffer(chroma.vector_audio(rng.normal(size=64)), "<i2") for _ in range(60)]
    rows = [(i, t.tobytes()) for i, t in enumerate(tunes)]
    for i in range(60):
        noisy = tunes[i][chroma.HOP * (i % 9) :] + rng.normal(0, 800, len(tunes[i]) - chroma.HOP * (i % 9))
        rows.append((100 + i, noisy.astype("<i2").tobytes()))
    rows += [(200, tunes[0].tobytes()), (201, None), (202, b""), (203, b"\0" * 400), (None, tunes[1].tobytes()), (5, tunes[5].tobytes())]
    df = spark.createDataFrame(rows, "media_id bigint, audio binary")
    out = chroma.align_recordings(df, F.col("media_id") % 10 == 0).collect()
    classes = {r.media_id: r.class_id for r in out if r.other_id is None}
    assert classes[200] == 0 and classes[201] == 201 and len(classes) == 124
    got = {(r.class_id, r.other_id) for r in out if r.other_id is not None}
    prints = {i: chroma.fingerprint(np.frombuffer(a, "<i2")) for i, a in rows if i is not None and a and classes[i] == i}
    prints = {i: p for i, p in prints.items() if len(p)}
    want = set()
    for q in prints:
        if q % 10 == 0 or (q == 0):
            for o in prints:
                if o != q:
                    tried = [chroma.bit_error(prints[q], prints[o], s) for s in range(-30, 31)]
                    tried = [e for e, n in tried if n >= chroma.OVERLAP * min(len(prints[q]), len(prints[o]))]
                    if min(tried) <= chroma.BIT_ERROR:
                        want.add((q, o))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 12
