"""outways: places, timetables and travel time as Spark DataFrame plans."""
