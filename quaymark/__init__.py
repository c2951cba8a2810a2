"""quaymark: a Spark-native analytics engine for model-selection data.

Everything is DataFrame in, DataFrame out.  ``operators`` holds relational and
numeric operators, ``sources`` readers and sinks, ``functions`` scalar column
functions, ``plans`` the registered queries, ``streaming`` stateful jobs.
"""

__version__ = "0.1.0"
