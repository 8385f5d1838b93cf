"""tidemark: transfer-metadata analytics on Spark.

Public operators by family (ids refer to the operator inventory):

* ``tidemark.functions.columns`` -- Column functions (X1-X19, F4-F6, A7)
* ``tidemark.sources`` -- S1-S12 readers
* ``tidemark.operators`` -- filters, runs, checksums, catalogue, progress,
  upload, and hot-key safe ordered scans
* ``tidemark.plans.resume`` -- G1-G3, J2-J5, J9, A6, W4, O3
* ``tidemark.sinks`` -- K1-K8 row shapes and writers
* ``tidemark.streaming.streams`` -- T1-T8
"""

__all__ = ["functions", "sources", "operators", "plans", "sinks", "streaming", "session", "schemas"]
