"""What op1_token_index and the pipeline's last stage hold at a time."""

import tracemalloc
import uuid

import pyarrow as pa

from tidemark.llm import token_index
from tidemark.llm.common import shared_dir
from tidemark.llm.queries import tokenizer_path

from .conftest import sentence


def test_pages_of_the_payload_hold_few_blocks(spark):
    """A page of 100 blocks takes 26 MB in each of the codecs' buffers."""
    docs = spark.createDataFrame([(i, sentence(i, 9_000)) for i in range(120)], "doc_id long, text string")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    token_index.write(docs, path, tokenizer_path(), parts=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = 0
    for name in spark.read.parquet(f"{path}/payload").inputFiles():
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        for group in reader.getRowGroups():
            column = next(c for c in group.getColumns() if c.getPath().toDotString() == "ids")
            starts = reader.readOffsetIndex(column)
            edges = [starts.getFirstRowIndex(i) for i in range(starts.getPageCount())] + [group.getRowCount()]
            assert max(b - a for a, b in zip(edges, edges[1:], strict=False)) * token_index.BLOCK_IDS * 2 <= 2 << 20
            found += group.getRowCount()
        reader.close()
    assert found >= 12


def test_encoding_holds_a_few_times_the_text():
    text = "\n".join(sentence(i, 200) for i in range(3_000))[: token_index.TOGETHER]
    words = token_index.WordEncoder(tokenizer_path())
    texts = pa.array([text[i : i + 4_096] for i in range(0, len(text), 4_096)])
    before = words.encode(texts, 1)
    tracemalloc.start()
    try:
        again = words.encode(texts, 1)
        assert tracemalloc.get_traced_memory()[1] < 9 * len(text)
    finally:
        tracemalloc.stop()
    assert again == before
    plain = [token_index.np.frombuffer(x.as_py(), words.type).tolist() for x in again]
    for i in range(0, len(plain), 97):
        assert plain[i] == [*words.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, 1]
