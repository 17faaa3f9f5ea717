"""Population-genetic queries over forests of genealogical trees, expressed as Spark plans."""

from grovewise.forest import Forest
from grovewise.model import TreeTables

__all__ = ["Forest", "TreeTables"]
