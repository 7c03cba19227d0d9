"""Assignment of arriving rows to fitted clusters."""
