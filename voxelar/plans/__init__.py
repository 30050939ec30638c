"""Plan helpers: materialised cuts in shared storage and size-checked broadcasts."""
