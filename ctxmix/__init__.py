"""ctxmix: Spark-native operators for evaluating retrieval-augmented question answering.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame -> DataFrame
steps), ``sources`` (readers and writers), ``plans`` (composed jobs and registered
queries) and ``streaming`` (incremental scoring of prediction files).
"""

__version__ = "0.1.0"
