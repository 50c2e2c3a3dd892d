"""skycap: Spark-native analytics for gridded observations, captions and embeddings.

Every public function takes and returns DataFrames (or Columns) so the whole
pipeline stays one lazy plan that Catalyst can prune, push down and codegen.
"""

__version__ = "0.1.0"
