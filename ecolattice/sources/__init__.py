"""Where exchange tables come from and go to."""
