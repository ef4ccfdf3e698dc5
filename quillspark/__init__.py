"""quillspark: document analytics as declarative Spark dataflow.

Sub-packages: ``sources`` (scans and decoders), ``functions`` (column expressions),
``operators`` (document operators), ``plans`` (query catalogue, tables, scratch space)
and ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
