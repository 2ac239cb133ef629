"""polytext: a Spark-native engine for preparing, checking, sampling and scoring
multilingual text corpora.

Sub-packages:

* ``sources``    -- readers and writers (JSON entries, text, TSV, shards, caches)
* ``functions``  -- pure Column builders (language tables, prompts, text, hashing)
* ``operators``  -- DataFrame -> DataFrame operators (QC, sampling, metrics,
                    tokens, batching, scoring, tuples, contamination)
* ``plans``      -- fixture views and the query registry used by the driver
* ``streaming``  -- Structured Streaming jobs (incremental scoring, progress)
"""

__version__ = "0.1.0"
