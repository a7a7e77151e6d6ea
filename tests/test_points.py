import math
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import points


def test_points(spark):
    make = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = [("c1", 1, 7, "f", 0, "ab ab c", {"source": "s", "chunk_index": "99"}), ("c2", 1, 7, "f", 1, None, None)]
    df = spark.createDataFrame(rows, "id string, kb_id int, document_id int, file_name string, chunk_index int, chunk_text string, metadata map<string,string>")
    enc = points.encode_dense(df, make, dimension=2, batch=1).withColumn("dense", points.unit(F.col("dense"))).withColumn("sparse", points.lexical_sparse(F.col("chunk_text")))
    got = {r.point_id: r for r in points.points(enc).collect()}
    one = got[str(uuid.uuid5(uuid.NAMESPACE_OID, "c1"))]
    assert one.dense == pytest.approx([7 / math.sqrt(50), 1 / math.sqrt(50)])
    a, b = math.log(3), math.log(2)
    assert one.sparse == pytest.approx({"ab": a / math.hypot(a, b), "c": b / math.hypot(a, b)})
    assert one.payload == {"chunk_text": "ab ab c", "kb_id": "1", "document_id": "7", "file_name": "f", "chunk_index": "99", "source": "s"}
    assert got[str(uuid.uuid5(uuid.NAMESPACE_OID, "c2"))].dense == pytest.approx([0.0, 1.0])


def test_wrong_dimension(spark):
    df = spark.createDataFrame([("x",)], "chunk_text string")
    with pytest.raises(Exception, match="dimension"):
        points.encode_dense(df, lambda: lambda texts: [[1.0]] * len(texts), dimension=2).collect()


def test_own_keys_leave_the_metadata(spark):
    df = spark.createDataFrame([({"kb_id": "1", "page": "2", "chunk_id": "c"},)], "m map<string,string>")
    assert df.select(points.source_metadata(F.col("m"))).head()[0] == {"page": "2"}
