import numpy as np


def unit(rows):
    rows = np.asarray(rows, dtype=np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def table(spark, vectors, name="doc_id"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
        f"{name} bigint, embedding array<float>",
    )
