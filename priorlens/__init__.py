"""Prior-work audits in bulk, written as Spark DataFrame transforms.

Sub-packages:

* ``functions`` - Column expressions (identifiers, titles, dates, URLs, hashes).
* ``operators`` - DataFrame-to-DataFrame operators keyed by ``audit_id``.
* ``sources``   - readers and writers.
* ``plans``     - views over the driver tables and the registered queries.
* ``streaming`` - Structured Streaming forms.
"""

__version__ = "0.1.0"
