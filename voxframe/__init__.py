"""voxframe: analytics over large collections of gridded and time-varying data, as Spark jobs."""
