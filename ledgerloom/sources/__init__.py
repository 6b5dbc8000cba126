"""Sources: pages of positioned text, checked and read in order; stored layouts."""
