"""Operators for training-data pipelines (cleaning, deduplication, search, packing).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.

Conventions shared by all operators:

* An operator selects the columns it needs by name, so further columns never clash with its own.
* A null text counts as an empty text unless the docstring says otherwise.
* Intermediate tables are written under ``spark.checkpoint.dir`` (see ``common.materialise``), so a lost
  executor costs a re-run task and never a lineage that was only in memory.
"""
