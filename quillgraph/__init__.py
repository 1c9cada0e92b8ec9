"""quillgraph: typed knowledge graphs, work journals and training corpora on Spark."""
