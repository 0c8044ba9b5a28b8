"""Where events and profiles come from and how they are stored."""
