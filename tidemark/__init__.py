"""Table evolution and change-data processing on Apache Spark.

Every operator is a plain function over DataFrames; see ``operators`` for the
batch operators, ``streaming`` for the Structured Streaming ones and
``plans`` for the shared distribution patterns (staging, hot-key splitting,
dense numbering).
"""
