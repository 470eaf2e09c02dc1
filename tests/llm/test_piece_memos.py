import pytest

from loomframe.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")


def test_query_holds_more_and_tells_the_same(spark, monkeypatch, tmp_path):
    """The query's workers have memos of its own size; what memos hold changes no result."""
    model, asked, real = pieces.read_model(tokenizers.path("piece_bpe_32k.model")), [], pieces.encoded_digests
    df = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(id, id + 40), x -> concat('word', x % 53, ', the ', hex(x * 7919), '.'))) AS text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pieces, "encoded_digests", lambda *a: asked.append(a[2:]) or real(*a))
    whole = sorted(map(tuple, pieces.op2_pieces(spark, str(tmp_path)).collect()))
    small = sorted(map(tuple, real(df, model, 4_000).collect()))
    assert asked == [(pieces.QUERY_MEMO_BYTES,)] and pieces.QUERY_MEMO_BYTES > pieces.MEMO_BYTES
    assert whole == small and len(whole) == 60
    assert pieces.Encoder(model, 4_000).words.most == 2_000 and pieces.Encoder(model).words.most == pieces.MEMO_BYTES // 2
