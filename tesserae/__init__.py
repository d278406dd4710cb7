"""A PySpark engine that turns source trees into queryable symbol graphs."""
