"""Run and metric analytics on Spark: tables of runs, rows and metric points, and the operations over them."""
