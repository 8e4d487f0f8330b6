"""Named analyses and jobs, composed from the operators."""
