"""DataFrame -> DataFrame analyses: staffing, demand, branches, segments, baskets, topics."""
