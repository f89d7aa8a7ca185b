"""Where entries come from and go to."""
