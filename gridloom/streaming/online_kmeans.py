"""Mini-batch k-means over a stream of score rows: one update a micro-batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.kmeans import MiniBatch, _pass


class OnlineKMeans:
    """The model, k x d numbers, is the driver's state; batches that were seen, by their number, are not counted twice."""

    def __init__(self, centroids: np.ndarray, share: float = 0.5):
        self.model, self.share, self.seen = MiniBatch.start(centroids), share, -1

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen:
            return
        total, n, _ = _pass(batch, {0: self.model.centroids})[0]
        if n.sum():
            self.model.update(total, n, self.share)
        self.seen = number

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
