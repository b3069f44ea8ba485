"""Point-in-time analytics for daily panels, written as DataFrame transformations."""
