"""Alignment against whole-text encoding and pairwise overlaps by definition."""

import collections
import hashlib

import pytest

from envatlas.llm import alignment, queries

TEXTS = [
    "Hello world, it's a test of naïve façades.", "", None, " leading", "trailing ", "two  blanks   three", "a\n\n b\t c\r\n  d", "▁under a▁b", "nul \x00 here", "漢字かな交じり文 mixed 汉字 text", "é é  nbsp 　wide   em", "👩‍👩‍👧‍👦 family 🏳️‍🌈",
    "<s> </s> <unk> <|endoftext|> <0x41> plain", " ", "  ", "\n", "x", "the the the the", "The quick brown fox don't can't we'll I'D", "1234567890 12,345.67 3rd", "word" * 300 + " end", "\x1c sep \x1f unit\x85next", "a ́b", "tab\tonly words", "die größte Straße überqueren", "Hello world, it's a test of naïve façades.",
]
SCHEMA = "doc_id bigint, text string"


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def brute(texts):
    """Whole texts encoded, spans by adding up bytes, every A-B pair of a text tried."""
    a, b = tokenizers()
    letter = alignment.letters_to_bytes()
    rows, counts, products = [], collections.Counter(), collections.Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            rows.append(None)
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in both:
            ga, gb = ([i for i, (s, e) in zip(ids, sp, strict=True) if start <= s and e <= end] for ids, sp in zip((ids_a, ids_b), spans, strict=True))
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            products.update((x, y) for x in ga for y in gb)
            start = end
        links, first = [], 0
        for x, (s, e) in zip(ids_a, spans[0], strict=True):
            while spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(ids_b) and spans[1][k][0] < e:
                links.append((x, ids_b[k]))
                k += 1
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            out.append((*r[:3], len(r[3]), hashlib.sha256(r[4].encode()).hexdigest(), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3])))
    return out, counts, products


def row(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)


FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.mark.parametrize("block", [1, 200, 1 << 20])
def test_alignment_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    df = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).repartition(3)
    got = {r.doc_id: row(r) for r in alignment.align(df, *map(queries.vocabulary, FILES)).collect()}
    want, _, _ = brute(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want


def test_pair_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).repartition(3)
    _, counts, products = brute(TEXTS)
    for wanted, flag in ((counts, False), (products, True)):
        assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(df, *map(queries.vocabulary, FILES), products=flag).collect()} == dict(wanted)


def test_alignment_of_edge_rows(spark):
    files = [*map(queries.vocabulary, FILES)]
    assert alignment.align(spark.createDataFrame([], SCHEMA), *files).count() == 0
    df = spark.createDataFrame([(None, "a b", "own", 1), (1, "a b", "own", 2), (1, "a b", None, 3)], "doc_id bigint, text string, N_A string, block int")
    out = alignment.align(df, *files, full=True)
    assert out.columns == ["doc_id", "N_A", "block", "n_a_", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    rows = sorted(out.collect(), key=lambda r: r.block)
    assert [(r.doc_id, r.N_A, r.n_a_, r.n_best, r.count_sum) for r in rows] == [(None, "own", 2, 2, 6), (1, "own", 2, 2, 6), (1, None, 2, 2, 6)]
    assert rows[0].groups_sha256 == hashlib.sha256(rows[0].groups.encode()).hexdigest()
    broken = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text union all select 2L, 'fine'")
    assert {r.doc_id: r.n_a for r in alignment.align(broken, *files).collect()} == {1: 0, 2: 1}


def test_registered_alignment(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: row(r) for r in queries.op13_alignment(spark, at).collect()}
    want, _, _ = brute([r.text for r in docs])
    assert [got[r.doc_id] for r in docs] == want
