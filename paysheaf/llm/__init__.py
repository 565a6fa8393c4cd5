"""Preparation of transcribed document texts as training data.

The operators work on *document texts*: one row per document with ``doc_id``, its
whole ``text`` (``records.document_text`` joins the pages of ``page_text``) and,
where an operator compares issuers, ``company``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Spark's tasks travel with them, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
