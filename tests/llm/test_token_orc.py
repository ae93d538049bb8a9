import random
import struct
import zlib

from ledgerlens.llm import registry, token_orc
from ledgerlens.llm.tokens import encoder


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_orc.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


ODD_TEXTS = [
    "Å á ́b  x\x1cy  z ΑΣ ΑΣΑ <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> I'LL don't it's ''s '",
    "İstanbul ǅ ﬁ ½ ²³ \x85 a\x0bb\x0cc ªµº ÀÉß×÷ \xad\xa0 ¼¾¿½ a½b'reve",
    "".join(chr(i) for i in range(33, 700)),
    " ".join(chr(i) for i in range(33, 700)),
    " ".join("x" + chr(i) + "'S" + chr(i) + "A" for i in range(33, 700)),
    None,
    "",
    "日本語 текст 🙂🙂 é",
    "The Cat sat <| here",
    "The Cat <|endoftext|> SAT <|EndOfText|> Here",
]


def test_encoder_is_the_library(spark):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encode = encoder(token_orc.tokenizer_path())
    for _ in range(2):  # the second time from the store
        assert [encode(t) for t in texts] == [packed(i) for i in library_ids(texts)]


def test_encoder_is_the_library_on_random_texts():
    """Capitals, added tokens and parts of them, signs, marks, odd spaces and other scripts, in any order."""
    rng = random.Random(11)
    parts = [
        "The", "CAT", "sat", "don't", "I'LL", "'S", "x", "Q", "<|", "|>", "<|endoftext|>", "<|startoftext|>",
        "<|ENDOFTEXT|>", "</w>", "<", "|", "0", "42", "3.14", "é", "É", "e\u0301", "ß", "ẞ", "İ", "Σ", "ΣΑΣ", "ǅ", "ﬁ",
        "½", "²", "日本", "текст", "ТЕКСТ", "🙂", "\u200d", "\u00ad", "\ufeff", "&amp;", "@", "_", "--", "...", "\x00",
    ]
    spaces = ["", "", " ", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randint(1, 9))) for _ in range(100_000)]
    encode = encoder(token_orc.tokenizer_path())
    assert [t for t, ids in zip(texts, library_ids(texts)) if encode(t) != packed(ids)] == []


def test_round_trip_through_orc(spark):
    rows = registry.op5_token_orc(spark, "/root/testdata/sf0.001").collect()
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    start, wanted = 0, {}
    for doc, ids in zip(docs, library_ids([d.text for d in docs])):
        ids = [*ids, 2]
        wanted[doc.doc_id] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == wanted


def test_files_hold_order_indexes_and_filters(spark, docs_of, tmp_path):
    from ledgerlens.llm.support import ready

    docs = docs_of([(i, f"words of document {i}") for i in range(300, 0, -1)])
    token_orc.write_tokens(docs, str(tmp_path / "ids"), token_orc.tokenizer_path(), 2)
    read = token_orc.read_tokens(ready(spark), str(tmp_path / "ids"))
    assert [r.doc_id for r in read.orderBy("start").collect()] == list(range(1, 301))
    plan = read.where("doc_id = 17")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)" in plan
    raw = b"".join(p.read_bytes() for p in (tmp_path / "ids").glob("*.orc"))
    assert raw.count(b"ORC")


def test_odd_documents(odd_docs, docs_of, spark, tmp_path):
    docs = odd_docs.selectExpr("*", "1 as part", "2 as ids", "3 as version")
    token_orc.write_tokens(docs, str(tmp_path / "odd"), token_orc.tokenizer_path(), 2)
    rows = token_orc.with_crc32(token_orc.read_tokens(spark, str(tmp_path / "odd"))).orderBy("start").collect()
    assert len(rows) == odd_docs.count() and rows[0].doc_id is None
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    token_orc.write_tokens(docs_of([]), str(tmp_path / "none"), token_orc.tokenizer_path(), 2)
    assert token_orc.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_a_look_up_by_document_skips_strides_and_files(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"words of {i}") for i in range(20_000)])
    token_orc.write_tokens(docs, str(tmp_path / "ids"), token_orc.tokenizer_path(), 2)
    near = spark.read.schema(token_orc.SCHEMA).orc(str(tmp_path / "ids")).where("doc_id = 12345").select("n_tokens")
    assert len(near.collect()) == 1

    def scanned(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            return node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlanExec":
            return scanned(node.executedPlan())
        children = node.children()
        return sum(scanned(children.apply(i)) for i in range(children.size()))

    # One stride of the one file that holds the document; the other files' statistics rule them out.
    assert 0 < scanned(near._jdf.queryExecution().executedPlan()) <= 2_000


def test_equal_rows_are_spread(spark, docs_of, tmp_path):
    docs = docs_of([(7, "the same text")] * 3_000 + [(i, f"text {i}") for i in range(5)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_orc.write_tokens(docs, str(tmp_path / "ids"), token_orc.tokenizer_path(), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in spark.read.orc(str(tmp_path / "ids")).groupBy("part").count().collect()]
    assert len(parts) > 2 and max(parts) < 0.6 * 3_005
    rows = token_orc.read_tokens(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert all(b.start == a.start + a.n_tokens and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))
