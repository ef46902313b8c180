"""pathloom: chunking, graph building, retrieval and evaluation over document graphs, as Spark plans."""

__version__ = "0.1.0"
