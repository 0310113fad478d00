"""Jobs: whole tasks over tables, each with a command line and a config file."""
