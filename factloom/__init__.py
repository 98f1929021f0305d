"""factloom: facts, graphs and evidence queries over documents, as Spark plans."""

__version__ = "0.1.0"
