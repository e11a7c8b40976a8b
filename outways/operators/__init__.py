"""DataFrame operators on places, timetables, road graphs, pages and feeds."""
