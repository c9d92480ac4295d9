"""tidewater: Spark-native data operators for tables and streams.

Everything here is a function from DataFrame(s) to a DataFrame, or a Column
builder. The work is declared with the DataFrame / SQL API so that Catalyst
plans it; no RDDs and no Python UDFs are used.
"""

from tidewater.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
