"""tracelake: transcript analytics and corpus processing as Spark jobs."""
