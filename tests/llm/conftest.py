import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts or (id, text) pairs, over a few partitions."""

    def make(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, DOC).repartition(parts)

    return make


#: nulls, empties, white space, odd characters, repeats, ties and a long text
EDGE_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "one two three four",
    "Tabs\tand\r\nreturns  and   blanks \n",
    "ünïcödé 日本語 テスト 🙂 é  nbsp　wide",
    "<|endoftext|> inside <|startoftext|>word<|endoftext|>",
    "it's they're don't 's 're CAN'T",
    "same words here and there again",
    "same words here and there again",
    "a" * 3000,
    "long text " * 3000 + "end.",
    "x\x00y \x1c z\u0085w",
]
