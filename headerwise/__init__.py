"""Check a new HTTP proxy version against production, as Spark jobs.

Three parts, each a set of DataFrame functions:

* ``plans.collect`` finds the most frequent requests in partitioned access logs;
* ``operators.replay`` turns them into a replay plan and guards it by content size;
* ``plans.compare`` pairs captured response headers, compares them by ordered
  per-domain rules and reports failing rows, an error histogram and a pass ratio.
"""

__version__ = "0.1.0"
