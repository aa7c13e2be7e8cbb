"""voltframe: Spark-native analytics for hourly grid series and the documents around them.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from DataFrame / Spark SQL
expressions; sinks and streaming drivers live apart from the operators.
"""

from voltframe.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
