"""The same results in DuckDB SQL, to check the Spark plans against."""
