"""siftgrid: indexed typed frames, set algebra and co-occurrence statistics on PySpark."""

__version__ = "0.1.0"
