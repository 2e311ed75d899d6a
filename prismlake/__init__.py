"""prismlake: a PySpark-native analytics engine for large media catalogues and text corpora."""

from prismlake.conf import EngineConf

__all__ = ["EngineConf"]
