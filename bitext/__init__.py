"""bitext: parallel-corpus building, cleaning, augmentation and scoring on Spark.

Every public function maps DataFrame(s) to a DataFrame with built-in Spark
expressions, joins, windows and aggregates.  Python runs inside tasks only in
the plug-in hooks (translator / embedder) and the LCS kernel of ROUGE-L.
"""

__version__ = "0.1.0"
