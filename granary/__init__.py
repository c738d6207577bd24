"""granary: a PySpark-native analytics engine.

Plans are declared with the DataFrame and SQL APIs and left to Catalyst and
AQE; Python code holds only policy, catalogue, commit protocol and registries.
"""
