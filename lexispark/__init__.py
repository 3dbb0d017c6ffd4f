"""lexispark: keyword and parallel-corpus preparation and MT evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column``
function built from Spark's own expressions, windows and aggregates.
No operator triggers an action unless its docstring says so (sources
and sinks that round-trip through files).
"""

__version__ = "0.1.0"
