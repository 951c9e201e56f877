"""Written tables in the shared folder that the session names in spark.checkpoint.dir."""

from ..plans.scratch import forget, shared_dir, table_path, written

__all__ = ["forget", "shared_dir", "table_path", "written"]
