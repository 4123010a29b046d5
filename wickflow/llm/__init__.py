"""Training-data operators: scans, mixing, fingerprints, archives, classifiers, packing, joins, token files.

Nothing outside this subpackage (but for ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py``) imports it.
"""
