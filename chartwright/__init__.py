"""Context-free-language queries over large collections of token sequences, on Spark."""
