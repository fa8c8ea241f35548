"""Column functions: file names, line rules and time stamps."""
