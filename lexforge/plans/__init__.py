"""Queries of the engine over the test tables; importing `all` registers every one."""
