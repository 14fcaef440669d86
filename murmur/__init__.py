"""murmur — comment analytics on Spark.

Every public function takes and returns DataFrames; work is planned by
Catalyst and run by Spark.  See README.md for the operator map.
"""

from murmur.params import Params

__all__ = ["Params"]
