"""What __spark_entry__ adds when this subpackage is there."""

from grovewise.llm.oracles import ORACLES
from grovewise.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
