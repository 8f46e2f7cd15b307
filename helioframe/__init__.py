"""helioframe: fleet telemetry decoding as Spark jobs."""
