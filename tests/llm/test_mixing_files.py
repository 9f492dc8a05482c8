"""What op9_hypergeometric_mixing and the pipeline's mixing write beside their result."""

import pathlib

from tidemark.llm import mixing
from tidemark.llm.common import shared_dir

from .conftest import sentence


def test_sizes_are_written_by_bytes(spark):
    """A few numbers a document don't make a file per split of the texts: on a local disk Hadoop starts three processes for each."""
    docs = [(i, sentence(i, 20 + i % 7), "abc"[i % 3]) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    shared = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("mix-sizes-*"))
    spread = sorted(map(str, mixing.mix(table.repartition(24)).collect()))
    assert spread == sorted(map(str, mixing.mix(table.coalesce(1)).collect()))
    written = [len(list(d.glob("part-*"))) for d in set(shared.glob("mix-sizes-*")) - before]
    assert len(written) == 2 and max(written) <= 4
