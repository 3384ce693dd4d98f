"""Analytics of database-application designs, and operators for training-data pipelines, on Spark.

load(spark, path) reads exports into a model; see plans.model.Model, plans.graph, plans.pages and sources.export for what can be done with it.
"""


def __getattr__(name: str):
    if name == "load":
        from .cli import load

        return load
    raise AttributeError(name)
