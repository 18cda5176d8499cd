"""Jobs to run by hand or from a scheduler; each module has a command line and a settings file beside it."""
