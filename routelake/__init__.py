"""routelake: Spark jobs over multi-model answer logs.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver on the data path.  Sub-packages:

- ``functions``  Column builders (text normalisation, answer extraction, vectors)
- ``operators``  table-in / table-out jobs (labels, ranking, scoring, routers, ...)
- ``sources``    readers and writers (CSV/JSON/parquet logs, checkpoints)
- ``streaming``  incremental variants built on Structured Streaming
- ``plans``      fixtures derived from the test tables, and the query registry
"""

__version__ = "0.1.0"
